import random
import time

import regex

from lexloom.functions.scan import Scanner, alternatives, compiled, contained, heads
from lexloom.operators import candidates as K
from lexloom.operators import retrieval as R


def test_heads():
    assert alternatives(r"a|(?:b|c)d|[|]e") == ["a", "(?:b|c)d", "[|]e"]
    assert heads(r"(?:công ty|cong ty)[^?.]{0,40}") == {"công ty", "cong ty"} and heads(r"trong\s+(?:thời\s+hạn|vòng)") == {"trong"}
    assert heads(r"\d{1,3}\s*%") is None and heads(r"x?y") is None and heads(r"abc?d") == {"ab"} and heads(r"Từ\s+\d") == {"từ"}


def test_scanner_finds_what_each_pattern_finds():
    rng = random.Random(2)
    words = ["phải", "PHẢI", "trừ", "trường", "hợp", "khi", "trong", "thời hạn", "vòng", "12", "%", "5 %", "từ", "đến", "thông báo", "phải bao gồm", "a.", ";", "Ⅷ", "İ", "được", "cấp", "cong ty", "doanh nghiệp", "\n", "\t"]
    texts = ["".join(rng.choice(words) + rng.choice(["", " ", " ", "  ", "_"]) for _ in range(30)) for _ in range(300)] + ["", "phải"]
    for patterns, whole in ((K.TRIGGERS, True), ([[rx] for _, rx in R.MENTION_PATTERNS], False)):
        own = Scanner(patterns, whole)
        assert len(own.slow) < len(patterns) / 4
        for t in texts:
            want = []
            for k, p in enumerate(patterns):
                rx = f"(?:{'|'.join(p)})"
                want += [(k, m.start(), m.end()) for m in compiled(rf"(?<![\p{{L}}\p{{N}}_]){rx}(?![\p{{L}}\p{{N}}_])" if whole else rx).finditer(t)]
            assert sorted(own.spans(t)) == sorted(want)


def test_blanks_and_digits_are_those_of_ascii():
    assert compiled(r"a\s+\d[\s\d]*").match("a 1 2\n") and not compiled(r"a\s+\d").match("a 1") and not compiled(r"\d").match("٣")
    assert isinstance(compiled(r"x"), regex.Pattern)


def test_contained():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc ") for _ in range(30)) for _ in range(50)] + [None, ""]
    patterns = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 6))) for _ in range(60)] + [""]
    assert list(contained(patterns, texts)) == [{p for p in patterns if p and p in (t or "")} for t in texts]


def clashes(texts):
    kept = []
    for i, t in enumerate(texts):
        if not any(t in texts[k] or texts[k] in t for k in kept):
            kept.append(i)
    return kept


def test_sweep_keeps_what_pairwise_comparison_keeps():
    rng = random.Random(6)
    for _ in range(300):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(rng.choice([1, 0]), 5))) for _ in range(rng.randrange(9))]
        assert K._apart(texts) == clashes(texts)


def test_long_texts_take_time_in_proportion(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["Doanh nghiệp phải nộp", "hồ sơ", "khi", "công ty", f"số {i}.", "được cấp giấy;", "cơ quan từ chối"]) for i in range(n))
    took = {}
    for words in (2000, 20_000):
        text = say(words // 2)
        own = K._Generator(K.TRIGGERS, K.EXCEPTION, K.EFFECT, K.PRE_CHARS, None, None, None)
        t0 = time.process_time()
        rows = own.of(text, own.squeezed(text))
        kept = K._apart([c.lower() for c, _ in rows])
        spans = list(Scanner([[rx] for _, rx in R.MENTION_PATTERNS], whole=False).spans(text))
        took[words] = time.process_time() - t0
        assert len(rows) > words / 20 and kept and spans
    assert took[20_000] < 40 * took[2000] + 1
    u = spark.createDataFrame([("u", text), ("v", None)], "unit_id string, text string")
    assert K.generate_candidates(u).count() == len(rows)
    assert K.dedupe_overlaps(K.generate_candidates(u).selectExpr("unit_id", "idx", "cand_text", "1.0D AS quality")).count() == len(kept)
    assert R.entity_mentions(u.withColumnRenamed("unit_id", "text_id")).count() == len({(a, text[a:z].strip(" ").lower()) for _, a, z in spans})
