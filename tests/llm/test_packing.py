from collections import defaultdict
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexloom.llm.packing import WordTokenizer, pack, plan_bins

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, World's don't 12345 x\x1cy", "a" * 3000, "É́ ́b ß\xa0　z q <|endoftext|>Hi <|startoftext|>",
         "日本語 テスト 'll we'LL ''s ...'re ½ ²3 ªº µ İstanbul ΣΑΣ", "same text", "same text", "wörd " * 5000, "in.&&& the%%% of***\n\n | x"]


def brute(texts, capacity):
    tok, out = Tokenizer.from_file(PATH), []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for p, a in enumerate(range(0, len(ids), capacity)):
            own = ids[a:a + capacity]
            out.append((i, p, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    return sorted(out)


def test_pieces_and_places(docs_of):
    got = pack(docs_of(list(enumerate(TEXTS))), PATH, capacity=512).collect()
    assert sorted(r[:5] for r in got) == brute(TEXTS, 512)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 512
    assert len(bins) == -(-sum(r.length for r in got) // 512)


def test_words_are_those_of_the_tokenizer():
    rng, tok, own = random.Random(1), Tokenizer.from_file(PATH), WordTokenizer(PATH)
    signs = list("aZbéÉß'sdtmrvel 0 9.,!|<>\t\ń\xa0İσΣ漢½") + ["<|endoftext|>", "'ll", "'RE"]
    for _ in range(400):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(60)))
        assert np.frombuffer(own(t.encode()), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_plan_is_near_the_bound_and_exact():
    rng = random.Random(2)
    for _ in range(20):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 50) for _ in range(rng.randrange(1, 60))}
        plan = plan_bins(histogram, 100)
        used = defaultdict(int)
        for filling, times in plan:
            assert sum(filling) <= 100
            for n in filling:
                used[n] += times
        assert used == histogram
        first_fit = []
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            i = next((i for i, r in enumerate(first_fit) if r >= n), None)
            if i is None:
                first_fit.append(100 - n)
            else:
                first_fit[i] -= n
        assert sum(times for _, times in plan) <= len(first_fit) + 1


def test_many_tiny_pieces_fill_their_bins():
    """Best fit of the long pieces leaves gaps, and more tiny pieces than nodes fit into one bin."""
    for histogram in ({1678: 15, 1029: 58, 1341: 5, 8: 913, 3: 2412}, {1248: 41, 1220: 28, 1233: 52, 1599: 17, 3: 3343}, {1112: 51, 1642: 51, 1703: 45, 1507: 10, 1100: 38, 5: 8889, 3: 1152}, {1: 9000}):
        plan = plan_bins(histogram, 4096)
        used = defaultdict(int)
        for filling, times in plan:
            assert sum(filling) <= 4096
            for n in filling:
                used[n] += times
        assert used == histogram
        assert sum(times for _, times in plan) == -(-sum(n * c for n, c in histogram.items()) // 4096)


def test_empty_table_and_ids(docs_of):
    assert pack(docs_of([]), PATH).count() == 0
    r = pack(docs_of([(7, "of the")]), PATH, keep_ids=True).collect()[0]
    assert r.ids == Tokenizer.from_file(PATH).encode("of the", add_special_tokens=False).ids + [1] and (r.sequence_id, r.offset) == (0, 0)
