"""Tables of the driver and inputs derived from them, in SQL that Spark and DuckDB both read."""

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

# name -> (inputs, SQL with {input} placeholders)
DERIVED: dict[str, tuple[list[str], str]] = {}

DERIVED["clauses"] = (["events"], """
SELECT concat('U', cast(event_id AS string)) AS unit_id,
       concat('D', cast(user_id AS string)) AS doc_id,
       concat('code ', cast(user_id % 7 AS string)) AS doc_code,
       cast(1 + user_id % 4 AS string) AS chapter,
       cast(1 + event_id % 40 AS string) AS article,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE cast(1 + event_id % 5 AS string) END AS clause,
       CASE WHEN event_id % 4 = 0 THEN substr('abcdef', cast(1 + event_id % 6 AS int), 1) END AS point,
       CASE WHEN event_id % 11 = 0 THEN 'Giải thích từ ngữ' ELSE 'Quy định chung' END AS heading,
       event_id, user_id, event_type, value,
       concat(
         CASE cast(user_id % 4 AS int) WHEN 0 THEN 'Doanh nghiệp ' WHEN 1 THEN 'Công ty ' WHEN 2 THEN 'Cơ quan thuế ' ELSE 'Người nộp thuế ' END,
         CASE cast(event_id % 12 AS int)
         WHEN 0 THEN concat('phải nộp hồ sơ đăng ký trong thời hạn ', cast(1 + user_id % 60 AS string), ' ngày làm việc kể từ ngày nhận thông báo.')
         WHEN 1 THEN concat('có trách nhiệm xem xét trong vòng ', cast(1 + user_id % 30 AS string), ' ngày; trường hợp từ chối phải thông báo bằng văn bản.')
         WHEN 2 THEN concat('không được chuyển nhượng cổ phần, trừ trường hợp có ít nhất ', cast(5 + user_id % 90 AS string), '% tổng số cổ phần phổ thông.')
         WHEN 3 THEN concat('nộp hồ sơ bao gồm giấy đề nghị số ', cast(user_id AS string), '; điều lệ công ty; danh sách thành viên.')
         WHEN 4 THEN 'nếu không đăng ký thì bị thu hồi giấy chứng nhận.'
         WHEN 5 THEN concat('có không quá ', cast(2 + user_id % 50 AS string), ' thành viên.')
         WHEN 6 THEN concat('được chuyển nhượng vốn góp, từ ', cast(1 + user_id % 9 AS string), ' đến ', cast(10 + user_id % 40 AS string), ' cổ đông.')
         WHEN 7 THEN concat('có quyền yêu cầu gia hạn, chậm nhất ', cast(1 + user_id % 12 AS string), ' tháng.')
         WHEN 8 THEN 'là tổ chức có tên riêng, có tài sản.'
         WHEN 9 THEN 'gian lận kèm theo hồ sơ giả là hành vi bị nghiêm cấm.'
         WHEN 10 THEN concat('sở hữu trên ', cast(10 + user_id % 80 AS string), '% vốn điều lệ có thể triệu tập họp.')
         ELSE concat('góp vốn đủ trong thời hạn ', cast(30 + user_id % 60 AS string), ' ngày khi được cấp giấy chứng nhận hết hiệu lực.') END) AS text
FROM {events}""")

DERIVED["answers"] = (["events"], """
SELECT event_id, user_id AS session_id,
       CASE cast(event_id % 5 AS int) WHEN 0 THEN 'bool' WHEN 1 THEN 'number' WHEN 2 THEN 'choice' WHEN 3 THEN 'date' ELSE 'duration' END AS kind,
       CASE cast(event_id % 5 AS int)
         WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN ' Có' WHEN event_id % 3 = 1 THEN 'khong' ELSE event_type END
         WHEN 1 THEN CASE WHEN event_id % 3 = 0 THEN concat(cast(user_id AS string), ',5') WHEN event_id % 3 = 1 THEN cast(user_id AS string) ELSE event_type END
         WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN upper(event_type) ELSE concat(event_type, ' ') END
         WHEN 3 THEN CASE WHEN event_id % 3 = 0 THEN concat(cast(1 + user_id % 28 AS string), '/', cast(1 + user_id % 12 AS string), '/2024')
                          WHEN event_id % 3 = 1 THEN concat('2023-', cast(1 + user_id % 12 AS string), '-', cast(1 + user_id % 28 AS string)) ELSE 'x/y/2024' END
         ELSE CASE WHEN event_id % 3 = 0 THEN concat(cast(user_id AS string), ' ngày') WHEN event_id % 3 = 1 THEN concat(cast(user_id AS string), ' days') ELSE event_type END
       END AS answer
FROM {events}""")

DERIVED["chunks"] = (["documents"], """
SELECT doc_id AS item_id, text, concat('R', cast(doc_id % 97 AS string)) AS rule_id, source,
       cast(1 + doc_id % 40 AS string) AS article, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE cast(1 + doc_id % 7 AS string) END AS clause
FROM {documents}""")

DERIVED["questions"] = (["benchmark"], """
SELECT item_id AS query_id, text, CASE WHEN item_id % 5 = 0 THEN NULL ELSE concat('R', cast(item_id % 97 AS string)) END AS rule_id,
       cast(1 + item_id % 40 AS string) AS article, cast(1 + item_id % 7 AS string) AS clause,
       substr(text, 1, 60) AS conclusion, substr(text, 10, 50) AS source_ref,
       CASE cast(item_id % 4 AS int) WHEN 0 THEN 'must' WHEN 1 THEN 'deadline' WHEN 2 THEN 'unknown' ELSE 'nop_ho_so' END AS goal_predicate
FROM {benchmark}""")

DERIVED["rules"] = (["part"], """
SELECT p_partkey, concat('R', cast(p_partkey % 1500 AS string)) AS rule_id,
       CASE cast(p_partkey % 3 AS int) WHEN 0 THEN 'enterprise' WHEN 1 THEN 'tax' ELSE 'labor' END AS domain,
       CASE WHEN p_partkey % 10 = 0 THEN 'shared' ELSE 'domain' END AS layer,
       lower(p_type) AS doc_code, cast(1 + p_partkey % 30 AS string) AS article,
       CASE cast(p_size % 9 AS int) WHEN 0 THEN 'obligation' WHEN 1 THEN 'permission' WHEN 2 THEN 'prohibition' WHEN 3 THEN 'deadline'
            WHEN 4 THEN 'threshold' WHEN 5 THEN 'applicability' WHEN 6 THEN 'legal_effect' WHEN 7 THEN 'procedure' ELSE 'dossier' END AS logic_form,
       CASE cast(p_partkey % 7 AS int) WHEN 0 THEN 'must' WHEN 1 THEN 'sanction' WHEN 2 THEN '' WHEN 3 THEN 'eligibility'
            WHEN 4 THEN lower(p_type) WHEN 5 THEN 'deadline' ELSE 'obligation' END AS head_predicate,
       concat('company_x,', replace(p_name, ' ', '_'), ',', CASE WHEN p_partkey % 5 = 0 THEN 'unknown' ELSE lower(p_type) END) AS head_args,
       concat(p_name, ' ', lower(p_type), ' thời hạn') AS surface, p_name, p_brand, p_type, p_size, p_retailprice
FROM {part}""")

DERIVED["seeds"] = (["lineitem", "part"], """
SELECT concat(cast(l_orderkey AS string), '_', cast(l_linenumber AS string), '_', cast(l_partkey AS string), '_', cast(l_suppkey AS string)) AS rule_id,
  concat('F', cast(l_orderkey AS string)) AS frame_id, concat('G', cast(l_orderkey AS string), '_', cast(l_linenumber % 3 AS string)) AS group_id,
  concat('U', cast(l_partkey AS string)) AS unit_id, concat(lower(p_type), ' ', cast(l_suppkey % 6 AS string)) AS doc_code,
  CASE cast(l_linenumber AS int) WHEN 1 THEN 'quy_tac_nghia_vu' WHEN 2 THEN 'quy_tac_quyen' WHEN 3 THEN 'quy_tac_nguong_dinh_luong' WHEN 4 THEN 'quy_tac_thoi_han'
       WHEN 5 THEN 'quy_tac_ho_so' WHEN 6 THEN 'quy_tac_dieu_kien' ELSE 'khac' END AS rule_type,
  CASE WHEN l_partkey % 4 = 0 THEN 'bat_buoc' WHEN l_partkey % 4 = 1 THEN 'quyen' WHEN l_partkey % 4 = 2 THEN 'cam' ELSE 'thoi_han' END AS nature,
  CASE WHEN l_suppkey % 3 = 0 THEN 'must' WHEN l_suppkey % 3 = 1 THEN '' ELSE 'xyz' END AS family,
  CASE WHEN l_quantity < 10 THEN NULL WHEN l_quantity < 30 THEN concat('dang_ky_', lower(p_type)) ELSE replace(p_name, ' ', '_') END AS canonical_predicate,
  CASE WHEN l_tax < 0.03 THEN NULL ELSE concat('t', cast(l_linenumber % 2 AS string), ':', replace(p_name, ' ', '_')) END AS typed_predicate,
  CASE WHEN l_discount < 0.01 THEN '' ELSE concat('Đăng ký ', p_name) END AS action,
  concat(p_name, ' ', CASE WHEN l_linenumber % 2 = 0 THEN 'Hồ sơ' ELSE 'hồ SƠ' END) AS object,
  CASE WHEN l_linenumber = 5 THEN concat('giấy ', p_name, '; bản sao ', lower(p_brand), ';điều lệ') END AS dossier,
  CASE WHEN l_returnflag = 'A' THEN concat('được cấp ', p_name) WHEN l_returnflag = 'R' THEN 'bị thu hồi' END AS effect,
  CASE WHEN l_linestatus = 'F' THEN concat('Cấp giấy ', p_type) END AS result,
  CASE cast(l_suppkey % 4 AS int) WHEN 0 THEN 'Doanh nghiệp' WHEN 1 THEN 'doanh  nghiep' WHEN 2 THEN 'Công ty' ELSE NULL END AS subject,
  CASE WHEN l_suppkey % 2 = 0 THEN 'tổ chức' ELSE 'cá nhân' END AS subject_type, CASE WHEN l_suppkey % 5 = 0 THEN 'người nộp' END AS subject_role,
  CASE WHEN l_partkey % 6 = 0 THEN 'Cơ quan thuế' WHEN l_partkey % 6 = 1 THEN 'co quan thue' END AS receiver,
  CASE WHEN l_partkey % 7 = 0 THEN 'Sở Kế hoạch' END AS handler, CASE WHEN l_partkey % 9 = 0 THEN 'toàn quốc' END AS scope,
  CASE WHEN l_linenumber = 3 AND l_suppkey % 3 <> 0 THEN concat('Tỷ lệ ', lower(p_type)) END AS metric,
  CASE WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN 'phần trăm' END AS unit, CASE WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN '>=' END AS op,
  CASE WHEN l_linenumber = 3 AND l_suppkey % 2 = 0 THEN cast(cast(l_quantity AS int) AS string) END AS threshold,
  CASE WHEN l_linenumber = 4 OR (l_linenumber = 3 AND l_suppkey % 7 = 0) THEN cast(1 + l_suppkey % 30 AS string) END AS deadline_value,
  CASE WHEN l_linenumber = 4 OR (l_linenumber = 3 AND l_suppkey % 7 = 0) THEN 'day' END AS deadline_unit,
  CASE WHEN l_linenumber = 4 THEN 'from_anchor' END AS anchor,
  CASE WHEN l_linenumber <> 6 AND l_partkey % 3 = 0 THEN concat('khi ', p_name) END AS condition,
  CASE WHEN l_partkey % 5 = 0 THEN concat('trừ trường hợp ', lower(p_type)) END AS exception,
  CASE WHEN l_suppkey % 8 = 0 THEN '' ELSE concat('Tóm tắt ', p_name, ' ', p_type) END AS summary,
  CASE WHEN l_suppkey % 6 = 0 THEN '' ELSE concat('Văn bản ', p_name, ' số ', cast(l_partkey AS string)) END AS source_text,
  CASE WHEN l_partkey % 13 = 0 THEN '' ELSE concat('Điều ', cast(l_partkey % 40 AS string), ', khoản ', cast(l_linenumber AS string)) END AS source_ref,
  CASE WHEN l_linenumber = 2 THEN 'cu' ELSE '' END AS notes
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""")

DERIVED["fact_log"] = (["events"], """
SELECT user_id AS case_id, event_id,
    CASE cast(event_id % 6 AS int) WHEN 0 THEN concat('numeric:', event_type) WHEN 1 THEN concat('metric:', event_type)
      WHEN 2 THEN concat('constraint:', event_type) WHEN 3 THEN concat('carrier(', event_type, ',', cast(cast(floor(value) AS bigint) AS string), ')')
      ELSE concat(event_type, '(a', cast(event_id % 7 AS string), ')') END AS fact_key,
    event_id % 5 <> 0 AS value_bool, CASE WHEN event_id % 6 < 3 AND event_id % 4 <> 0 THEN CASE WHEN event_id % 8 = 1 THEN value / 500 ELSE value END END AS value_num
FROM {events}""")

DERIVED["facts"] = (["fact_log"], """
SELECT l.case_id, l.fact_key, value_bool, value_num FROM {fact_log} l JOIN
  (SELECT case_id, fact_key, max(event_id) AS event_id FROM {fact_log} GROUP BY case_id, fact_key) m
  ON l.case_id = m.case_id AND l.fact_key = m.fact_key AND l.event_id = m.event_id""")

DERIVED["candidates"] = (["lineitem"], """
SELECT l_suppkey AS case_id, concat('R', cast(l_partkey AS string)) AS rule_id, max(l_extendedprice) / 10000 AS score,
  max(l_discount) * 10 AS exact_head, cast(max(l_linenumber) AS bigint) AS n_bindings, max(l_tax) * 10 AS compatibility, min(l_partkey) % 10 = 0 AS shared
FROM {lineitem} GROUP BY l_suppkey, l_partkey""")

DERIVED["atoms"] = (["part"], """
SELECT concat('R', cast(p_partkey AS string)) AS rule_id, 'positive' AS role, 0 AS seq,
  concat(CASE cast(p_partkey % 5 AS int) WHEN 0 THEN 'view' WHEN 1 THEN 'purchase' WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'click' END, '(a', cast(p_partkey % 7 AS string), ')') AS key FROM {part}
UNION ALL SELECT concat('R', cast(p_partkey AS string)), 'positive', 1, concat('view(a', cast(p_size % 7 AS string), ')') FROM {part} WHERE p_size % 3 = 0
UNION ALL SELECT concat('R', cast(p_partkey AS string)), 'unless', 0, concat('error(a', cast(p_size % 7 AS string), ')') FROM {part} WHERE p_size % 4 = 0
UNION ALL SELECT concat('R', cast(p_partkey AS string)), 'exception', 0, concat('signup(a', cast(p_size % 7 AS string), ')') FROM {part} WHERE p_partkey % 6 = 0""")

DERIVED["constraints"] = (["part"], """
SELECT concat('R', cast(p_partkey AS string)) AS rule_id, 0 AS seq, CASE cast(p_size % 5 AS int) WHEN 0 THEN 'deadline' WHEN 1 THEN 'dossier' WHEN 2 THEN 'threshold_note' ELSE 'threshold' END AS kind,
  concat('constraint:', CASE cast(p_partkey % 3 AS int) WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE 'nothing' END) AS session_key,
  CASE cast(p_partkey % 4 AS int) WHEN 0 THEN 'view' WHEN 1 THEN 'purchase' WHEN 2 THEN 'signup' ELSE 'absent' END AS metric,
  CASE cast(p_partkey % 6 AS int) WHEN 0 THEN '>=' WHEN 1 THEN 'lte' WHEN 2 THEN 'gt' WHEN 3 THEN '<' WHEN 4 THEN 'eq' ELSE '~' END AS op,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE cast(p_size AS double) END AS target, CASE WHEN p_partkey % 2 = 0 THEN 'phan_tram' ELSE '' END AS unit
FROM {part}""")

DERIVED["results"] = (["orders"], """
SELECT o_orderkey AS id, CASE cast(o_orderkey % 5 AS int) WHEN 0 THEN 'success' WHEN 1 THEN 'partial' WHEN 2 THEN 'error' WHEN 3 THEN '' ELSE 'success' END AS status,
  concat(CASE WHEN o_custkey % 3 = 0 THEN 'tax' ELSE 'labor' END, ',enterprise_x') AS doms, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE concat('R', cast(o_custkey AS string)) END AS selected_rule_id,
  CASE WHEN o_orderkey % 7 < 3 THEN '' ELSE 'Dieu 1' END AS cites, o_orderpriority < '3' AS proof_present, CASE WHEN o_custkey % 2 = 0 THEN 'N/A' ELSE 'PASS' END AS v_forward,
  CASE WHEN o_custkey % 10 < 4 THEN 'N/A' ELSE 'PASS' END AS v_rule, CASE WHEN o_custkey % 10 < 3 THEN 'N/A' WHEN o_custkey % 10 < 5 THEN 'FAIL' ELSE 'PASS' END AS v_parse,
  CASE WHEN o_custkey % 10 < 4 THEN 'N/A' WHEN o_custkey % 10 = 9 THEN 'FAIL' ELSE 'PASS' END AS v_answer, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('f', cast(o_orderkey % 4 AS string), ',F', cast(o_custkey % 3 AS string)) END AS mf,
  CASE WHEN o_orderkey % 13 = 0 THEN 'timeout' END AS error FROM {orders}""")

DERIVED["gold"] = (["orders"], """
SELECT o_orderkey AS id, CASE cast(o_custkey % 4 AS int) WHEN 0 THEN 'tax' WHEN 1 THEN 'labor' WHEN 2 THEN 'enterprise' ELSE NULL END AS domain,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS question_group, CASE cast(o_orderkey % 3 AS int) WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'A+B' END AS mode,
  CASE WHEN o_custkey % 5 = 0 THEN '' ELSE concat('F', cast(o_orderkey % 4 AS string), ',f', cast(o_custkey % 2 AS string)) END AS gm, o_orderkey % 8 <> 0 AS must_answer, o_custkey % 2 = 0 AS must_cite
FROM {orders}""")
