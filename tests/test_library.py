"""Operators on inline Chinese fixtures, span algebra, plans and streaming."""

from __future__ import annotations

import re
import random

import pytest
from pyspark.sql import functions as F


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(col.alias("x")).first()["x"]


def test_dates_and_numbers(spark):
    from lexmill.functions import text as T

    rows = [("2026年8月5日", "2026-08-05"), ("2026.8.5", "2026-08-05"), ("2026年", "2026-01-01"), ("2026年2月30日", ""), ("x", "")]
    got = spark.createDataFrame(rows, "d string, w string").select(T.normalize_date(F.col("d")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)
    got = [tuple(r[0]) for r in spark.createDataFrame([("×政办发〔2026〕12号",), ("×政办发（2026）12号",), ("abc",)], "d string").select(T.parse_doc_no(F.col("d"))).collect()]
    assert got == [("×政办发", "2026", 12), ("×政办发", "2026", 12), ("", "", 0)]
    safe = spark.createDataFrame([("=1+1",), ("-5",), ("@x",), ("a",)], "v string").select(T.csv_safe(F.col("v"))).collect()
    assert [r[0] for r in safe] == ["'=1+1", "-5", "'@x", "a"]
    assert one(spark, T.set_tags(F.col("t"), F.array(F.lit("d")), F.array(F.lit("b"))), t="a,b，c") == "a，c，d"
    kinds = one(spark, F.transform(T.personal_data(F.col("t")), lambda x: x["kind"]), t="110101199003077715 13812345678 a.b@c.de 010-12345678")
    assert set(kinds) == {"id_card", "mobile", "email", "landline"}


def test_numerals(spark):
    from lexmill.functions.numerals import amount_cn, cn_to_number, date_cn

    assert [cn_to_number(x) for x in ("十二", "三百零五", "一万二千", "二〇二六", "三点五", "两亿", "x", "")] == [12, 305, 12000, 2026, 3.5, 2e8, None, None]
    assert amount_cn("1005000.00") == "人民币壹佰万零伍仟元整" and amount_cn("0") == "零元整" and amount_cn("1.999") is None and amount_cn("0.05") == "人民币伍分" and amount_cn("10.01") == "人民币壹拾元零壹分"
    assert one(spark, date_cn(F.lit("2026-08-21"))) == "二〇二六年八月二十一日"


def test_consistency():
    from lexmill.operators import consistency as K

    text = "材料收到后5个工作日答复，超过五个工作日须说明"
    found = K.numbers(text)
    assert len(found) == 1 and found[0][2:4] == ("5个工作日", "五个工作日") and len(found[0][4]) == 2
    assert not K.numbers("3个工作日和5个工作日") and not K.numbers("3—5个工作日，三至五个工作日") and not K.numbers("第3项和第三项")
    assert [f[0] for f in K.date_order("工期为2024年9月到2023年2月")] == ["date_order"] and not K.date_order("工期为2023年2月到2024年9月")
    assert [f[2] for f in K.date_order("2024年9月5日至3月1日；2024年3月1日—9月5日")] == ["2024年9月5日至3月1日"]
    assert len(K.dates("2021年4月9日签发，2021-04-09施行")) == 1 and not K.dates("2021年4月9日")
    assert len(K.sequence("（一）a\n（二）b\n（四）c")) == 1 and not K.sequence("（一）a\n（三）b")


def test_registers(spark):
    from lexmill.operators import ledger as L

    reg = spark.createDataFrame([(1, "2026-08-03", "", "open"), (2, "2026-08-04", "", "open"), (3, "", "", "open"), (4, "2026-08-01", "", "closed")], "id long, due_date string, done_date string, status string")
    assert [r["id"] for r in L.pending_due(reg, "2026-08-01", 2, ("closed",)).collect()] == [1]
    assert L.pending_due(reg, "no date", 2, ("closed",)).count() == 0
    months = spark.createDataFrame([("2026-01-05",), ("2026-01-09",), ("2026-12-01",), ("2026-xx-01",)], "sign_date string")
    assert [r["n"] for r in L.monthly(months, "2026").orderBy("month").collect()] == [2, *[0] * 10, 1]
    serial = L.max_serial(spark.createDataFrame([("市函〔2021〕7号、〔2021〕31号",)], "doc_no string")).first()
    assert serial["max_serial"] == 31
    nxt = L.next_numbers(spark.createDataFrame([("发（2026）1号",)], "doc_no string"), spark.createDataFrame([(7, "发", "2026")], "id long, prefix string, year string")).first()
    assert nxt["serial"] == 2
    rows = [(1, "XX局2026-0007", "2026-01-01", "2026-02-01", ""), (2, "", "2026-01-01", "2026-02-01", ""), (3, "", "2026-03-01", "2026-04-01", ""), (4, "", "2025-01-01", "2025-02-01", "")]
    got = L.archive_numbers(spark.createDataFrame(rows, "id long, archive_no string, receive_date string, done_date string, doc_date string"), "XX局", "2024").orderBy("id").collect()
    assert [r["archive_no"] for r in got] == ["XX局2026-0008", "XX局2026-0009", "XX局2025-0001"]
    with pytest.raises(ValueError):
        L.group_stats(reg, "id")


def test_span_resolution_is_greedy_and_disjoint():
    from lexmill.operators.detect import resolve

    lex = lambda a, b, c: (a, b, "", "", "lexicon", c)
    rule = lambda a, b, c: (a, b, "", "", "rule", c)
    assert [h[:2] for h in resolve([lex(0, 6, 0.85), rule(0, 2, 0.9)])] == [(0, 6)]
    assert [h[5] for h in resolve([rule(0, 4, 0.55), rule(0, 2, 0.98)])] == [0.98]
    assert [h[:2] for h in resolve([rule(8, 10, 0.5), rule(0, 2, 0.5)])] == [(0, 2), (8, 10)]
    rng = random.Random(7)
    for _ in range(60):
        hits = []
        for _ in range(rng.randint(0, 60)):
            a = rng.randint(0, 120)
            hits.append(rule(a, a + rng.randint(1, 8), rng.choice([0.5, 0.7, 0.9])))
        slow = []
        for h in sorted(hits, key=lambda h: (-h[5], h[0] - h[1])):
            if not any(h[0] < k[1] and k[0] < h[1] for k in slow):
                slow.append(h)
        assert resolve(hits) == sorted(slow)


def test_severity_and_apply(spark):
    from lexmill.operators import detect as D

    docs = spark.createDataFrame([(1, "teh teh2 teh. adn x"), (2, None)], "id long, content string")
    rules = D.Rules(pairs=[D.Pair("teh", "the"), D.Pair("adn", "and", "style", 0.9)])
    hits = D.severity(D.check_documents(docs, rules), docs).orderBy("start").collect()
    assert [h["severity"] for h in hits] == ["error", "error", "warning", "suggest"]
    assert D.apply_hits("abc wrong", [(4, 9, "wrong", "right", "abc ")])[0] == "abc right"
    assert D.apply_hits("NEW abc wrong", [(4, 9, "wrong", "right", "abc ")]) == ("NEW abc right", 1, 0)
    assert D.apply_hits("x abc wrong abc wrong", [(4, 9, "wrong", "right", "abc ")])[1:] == (0, 1)


def test_similarity(spark):
    from lexmill.operators import similarity as M

    rows = spark.createDataFrame([("甲乙", "甲乙丙", 0.5), ("", "", 1.0), ("", "x", 0.0)], "a string, b string, w double")
    assert all(r["s"] == r["w"] for r in rows.select(M.jaccard(F.col("a"), F.col("b")).alias("s"), "w").collect())
    texts = ["关于开展安全生产检查工作的通知要求各单位认真落实", "关于开展安全生产检查工作的通知要求各单位认真落实。", "完全不同的另外一段话"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    assert [(r["a"], r["b"]) for r in M.find_similar(docs, 0.7).collect()] == [(0, 1)]


def test_store(spark):
    from lexmill.operators import corpus as C

    old = spark.createDataFrame([(1, "h1", ""), (2, "h2", "2024-01-01")], "id long, text_hash string, deleted_time string")
    new = spark.createDataFrame([(10, "h1"), (11, "h2"), (12, "h3"), (13, "h3")], "id long, text_hash string")
    got = {r["id"]: (r["action"], r["restored_id"]) for r in C.add_documents(old, new).collect()}
    assert got == {10: ("duplicate", None), 11: ("restore", 2), 12: ("insert", None), 13: ("duplicate", None)}
    state = spark.createDataFrame([(1, "h1"), (2, "x"), (9, "z")], "ref_id long, text_hash string")
    docs = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "id long, text_hash string")
    assert {r["id"]: r["action"] for r in C.index_changes(docs, state).collect()} == {2: "refresh", 3: "add", 9: "drop"}
    again = docs.select(F.col("id").alias("ref_id"), "text_hash")
    assert C.index_changes(docs, again).count() == 0


def test_structure(spark):
    from lexmill.operators import structure as S

    text = "# 标题\n一、总体要求\n这是一行没有\n结束的话。\n\n（一）任务"
    blocks = S.normalize(text)
    assert [b[0] for b in blocks] == ["paragraph", "heading", "paragraph", "heading"] and blocks[2][2] == "这是一行没有结束的话。"
    assert S.normalize("\n".join(b[2] for b in blocks)) == blocks
    assert S.locate("ab cd", ["ab", "zz", "cd"]) == [0, -1, 3]
    assert [p for _, p in S.heading_chain([(1, 1), (2, 1), (2, 2), (2, 4), (1, 1), (3, 1)])] == ["skipped", "level jump"]
    rows = spark.createDataFrame([("g", 1, 60), ("g", 2, 50), ("g", 3, 40)], "g string, id long, size long")
    assert [r["included"] for r in S.within_budget(rows, "g", "size", 100).orderBy("id").collect()] == [True, False, True]


def test_parsers(spark, tmp_path):
    from lexmill.sources import parsers as P

    title, blocks = P.parse_markdown("# T\n\ntext **bold** [a](b)\n- item\n```\n# code\n```")
    assert title == "T" and [b[0] for b in blocks] == ["heading", "paragraph", "list_item", "paragraph"] and blocks[1][2] == "text bold a"
    title, blocks = P.parse_html("<title>X</title><script>no</script><h1>H</h1><p>a <b>b</b></p><li>c")
    assert title == "X" and [b[2] for b in blocks] == ["H", "a b", "c"]
    assert P.decode("中文".encode("gb18030")) == "中文" and not P.parse_any("a.xyz", b"x")["ok"] and not P.parse_any("a.txt", b"")["ok"]
    (tmp_path / "a.md").write_text("# A\nb")
    (tmp_path / "b.bin").write_bytes(b"\0")
    assert {r["name"]: r["ok"] for r in P.read_files(spark, str(tmp_path)).collect()} == {"a.md": True, "b.bin": False}
    lst = tmp_path / "words.csv"
    lst.write_text("wrong;correct;confidence\n# no\nteh;the;2\n")
    assert [tuple(r) for r in P.read_word_list(spark, str(lst)).select("wrong", "correct", "confidence").collect()] == [("teh", "the", 1.0)]


def test_streaming(spark):
    from lexmill.streaming import ingest as I

    import os
    import tempfile

    d = tempfile.mkdtemp()
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(os.path.join(d, "events"))
    stream = I.windowed_counts(I.read_table_stream(spark, os.path.join(d, "events"), 10), "1 day")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from counts").first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("ts is not null").count()


def test_plans_have_no_accidental_products(spark):
    from lexmill.plans.registry import QUERIES

    for name in ("sim_jaccard", "join_substring", "join_interval_overlap", "join_anti_orphan", "dml_incremental_index"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    scan = QUERIES["flt_dispatch"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in scan


def store(spark, contents, first_id=0):
    rows = [(first_id + i, c) for i, c in enumerate(contents)]
    return lambda *_: spark.createDataFrame(rows, "id long, content string")


def test_sim_pairs_reads_documents_of_any_length(spark, monkeypatch):
    from lexmill.plans import corpus

    rng = random.Random(21)
    base = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(500)) for _ in range(4)]
    texts = [v for t in base for v in (t, t[:-300] + t[:300], t[: len(t) * 2 // 3])] + ["short text", "short texts", ""]
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in (t.replace(" ", "") for t in texts)]
    want = {(i, j): round(len(a & b) / len(a | b), 6) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a | b}
    want = {k: v for k, v in want.items() if v >= 0.7}
    monkeypatch.setattr(corpus, "documents", store(spark, texts))
    got = {(r["a"], r["b"]): r["similarity"] for r in corpus.QUERIES["sim_pairs"](spark, "").collect()}
    assert got == want and any(len(texts[i]) > 1500 for i, _ in got)


def test_sim_diff_lines_reads_every_id(spark, monkeypatch):
    from lexmill.plans import corpus

    monkeypatch.setattr(corpus, "documents", store(spark, ["short\nlonger line\nend"], first_id=5000))
    got = [(r["id"], r["op"]) for r in corpus.QUERIES["sim_diff_lines"](spark, "").collect()]
    assert got == [(5000, "equal"), (5000, "replace"), (5000, "equal")]


def test_consistency_and_headings_read_whole_texts(spark, monkeypatch):
    from lexmill.plans import structure_plans as P

    monkeypatch.setattr(P, "documents", store(spark, ["x" * 300 + "共30人，又三十人。", "\n".join(["a"] * 30 + ["aaaa"])]))
    got = {(r["id"], r["first"], r["variant"]) for r in P.QUERIES["con_check"](spark, "").collect()}
    assert (0, "30人", "三十人") in got
    got = [(r["position"], r["problem"]) for r in P.QUERIES["win_heading_chain"](spark, "").where("id = 1").collect()]
    assert got == [(0, "level jump"), (30, "skipped")]


def test_clean_and_control_characters(spark):
    from lexmill.operators.structure import clean

    rows = spark.createDataFrame([("a\n\n\n\nb",), ("  x\x01\x07y",), ("p\r\nq\x0cr",), ("",)], "t string").select(clean(F.col("t"))["text"].alias("c"))
    got = [r["c"] for r in rows.collect()]
    assert got[0] == "a\n\nb" and "\x01" not in got[1] and "\x07" not in got[1] and got[3] == ""


def test_marks_material_and_gates(spark):
    from lexmill.functions import text as T
    from lexmill.operators import detect as D

    docs = spark.createDataFrame([(1, "a <loser> & loser"), (2, "none")], "id long, content string")
    hits = D.check_documents(docs, D.Rules(pairs=[D.Pair("loser", "rival")], repeats=False))
    html = {r["id"]: r["html"] for r in D.marked_html(hits, docs).collect()}
    mark = '<mark class="lexicon" title="rival">loser</mark>'
    assert html == {1: f"a &lt;{mark}&gt; &amp; {mark}"}
    m = one(spark, T.material(F.lit("# Title \n@TAGS a| b\nbody\nmore")))
    assert (m["title"], m["tags"], m["body"]) == ("Title", ["a", "b"], "body\nmore")
    assert one(spark, T.material(F.lit("no title")))["title"] == "" and one(spark, T.looks_binary(F.lit("abc\x00"))) and not one(spark, T.looks_binary(F.lit("plain")))


def test_search_in_texts_without_spaces(spark):
    from lexmill.functions import text as T
    from lexmill.operators import search as S

    assert one(spark, T.tokens(F.lit("关于加强用水管理的通知2024 Water USE"))) == ["关于", "于加", "加强", "强用", "用水", "水管", "管理", "理的", "的通", "通知", "2024", "water", "use"]
    assert one(spark, T.tokens(F.lit("水 water"))) == ["水", "water"] and one(spark, T.tokens(F.lit("abc d1"))) == ["abc", "d1"]
    docs = spark.createDataFrame([(1, "通知", "关于加强用水管理的通知"), (2, "报告", "用电情况的报告"), (3, "x", "plain words")], "id long, title string, content string")
    hits = docs.select("id", F.arrays_overlap(T.tokens(F.col("content")), T.tokens(F.lit("用水"))).alias("hit")).where("hit").collect()
    assert [r["id"] for r in hits] == [1] and S is not None


SF = "/root/testdata/sf0.001"


def test_similarity_by_force(spark):
    from lexmill.plans.registry import QUERIES
    from lexmill.plans.views import documents

    docs = {r["id"]: re.sub(r"\s", "", r["content"]) for r in documents(spark, SF).collect()}
    grams = {i: {t[k : k + 3] for k in range(len(t) - 2)} for i, t in docs.items()}
    want = {}
    for a, x in grams.items():
        for b, y in grams.items():
            if a < b and x and y and (s := round(len(x & y) / len(x | y), 6)) >= 0.7:
                want[a, b] = s
    assert {(r["a"], r["b"]): r["similarity"] for r in QUERIES["sim_jaccard"](spark, SF).collect()} == want


def test_ngram_pairs_ship_sets_not_grams(spark, monkeypatch):
    """Many texts of one vocabulary: nothing is joined by n-gram, and every pair of any size, block and copy is found."""
    from lexmill.operators import similarity as M

    rng = random.Random(5)
    words = ["".join(rng.choices("abcdef", k=rng.randint(2, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 10, 40, 150]))) for _ in range(150)]
    texts += [t[: len(t) * 9 // 10] for t in texts[::3]] + ["文件\u3000通知书", "文件通知书\x1f", "", "ab", "\U00020000\U00020001\U00020002x"] + ["the same text"] * 40
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in ("".join(t.split()) for t in texts)]
    want = {(i, j): s for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and (s := round(len(a & b) / len(a | b), 6)) >= 0.7}
    df = M.ngram_pairs(store(spark, texts)(), 0.7)
    rows = df.collect()
    assert len(rows) == len(want) > 800 and {(r["a"], r["b"]): r["similarity"] for r in rows} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_sim_jaccard_measures_short_texts_at_their_length(spark, monkeypatch):
    """Order min(3, lengths) and equal empty texts, by force; the texts' groups are split into cells, an id that repeats makes no pair with itself."""
    from lexmill.operators import ngram_join
    from lexmill.operators import similarity as M
    from lexmill.plans import corpus

    def jaccard(a, b, n):
        if not a or not b:
            return float(a == b)
        n = min(n, len(a), len(b))
        x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
        return len(x & y) / len(x | y)

    def by_force(texts, least, n=3):
        plain = ["".join((t or "").split()) for t in texts]
        return sorted((i, j, round(s, 6)) for i, a in enumerate(plain) for j, b in enumerate(plain) if i < j and (s := jaccard(a, b, n)) >= least)

    rng = random.Random(3)
    texts = ["", None, " \n\u3000", "甲", "甲 甲", "甲甲甲甲", "甲乙", "甲乙", "甲乙丙", "\x00", "\x00a", "\x00\x00a", "a", "a\u0301", "\U00020000", "\U00020000\U00020000\U00020000"]
    texts += ["".join(rng.choices("ab c", k=rng.randint(0, 7))) for _ in range(120)] + ["x"] * 9 + ["a long text"] * 3
    docs = store(spark, texts)
    monkeypatch.setattr(corpus, "documents", docs)
    got = sorted(tuple(r) for r in corpus.QUERIES["sim_jaccard"](spark, "").collect())
    assert got == by_force(texts, 0.7) and {(0, 1, 1.0), (3, 5, 1.0), (6, 7, 1.0)} <= set(got)
    monkeypatch.setattr(ngram_join, "CELL", 7)
    for least, n in ((0.2, 3), (0.333334, 3), (0.4, 2), (0.7, 1)):
        assert sorted(tuple(r) for r in M.ngram_pairs(docs(), least, n, lower=True).collect()) == by_force(texts, least, n)
    again = spark.createDataFrame([(1, "a"), (1, "a"), (2, "aa"), (3, "long text"), (3, "long text")], "id long, content string")
    assert [tuple(r) for r in M.ngram_pairs(again, 0.7, lower=True).collect()] == [(1, 2, 1.0)] * 2


def test_find_similar_gates_without_joins(spark):
    """The SimHash of both documents comes with their sets; pairs beyond the gate are left out."""
    from collections import Counter

    from lexmill.operators import similarity as M

    def simhash(text):
        ts = re.findall(r"[a-z0-9]+", text)
        votes = [0] * 64
        for f, n in Counter(x for x in [*ts, *map("".join, zip(ts, ts[1:]))] if len(x) >= 2).items():
            h = 0xCBF29CE484222325
            for c in f.encode():
                h = (h ^ c) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
            votes = [v + (n if h >> i & 1 else -n) for i, v in enumerate(votes)]
        return sum(1 << i for i, v in enumerate(votes) if v > 0)

    rng = random.Random(9)
    texts = []
    for _ in range(60):
        t = "".join(rng.choices("abcde", k=rng.choice([12, 40, 300])))
        cut = rng.randint(2, 9)
        texts += [t, " ".join(t[i : i + cut] for i in range(0, len(t), cut)), t[: len(t) - 2]]  # other words, the same n-grams
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in (t.replace(" ", "") for t in texts)]
    near = {(i, j): s for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and (s := round(len(a & b) / len(a | b), 6)) >= 0.7}
    h = [simhash(t) for t in texts]
    want = {k: v for k, v in near.items() if 1 - (h[k[0]] ^ h[k[1]]).bit_count() / 64 >= 0.7 - 0.25}
    df = M.find_similar(store(spark, texts)(), 0.7)
    rows = df.collect()
    assert len(rows) == len(want) < len(near) and {(r["a"], r["b"]): r["similarity"] for r in rows} == want
    assert "MergeJoin" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "ShuffledHashJoin" not in plan


def test_budgets_by_force(spark):
    from lexmill.plans.registry import QUERIES

    total, groups = {}, {}
    for r in sorted(QUERIES["win_budget"](spark, SF).collect(), key=lambda r: r["id"]):
        n = total.get(r["category"], 0) + r["word_count"]
        assert r["included"] == (n <= 50_000)
        total[r["category"]] = n if r["included"] else n - r["word_count"]
        groups[r["category"]] = groups.get(r["category"], 0) + 1
    assert sum(groups.values()) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_genres_by_force(spark):
    from lexmill.plans.registry import QUERIES
    from lexmill.plans.text_plans import KEYS
    from lexmill.plans.views import documents

    kind = {r["id"]: r["file_type"] for r in documents(spark, SF).collect()}
    m = {r["id"]: [float(r[k]) for k in KEYS] for r in QUERIES["txt_style"](spark, SF).collect()}

    def at(v, p):
        v, k = sorted(v), (len(v) - 1) * p
        return round(v[int(k)] + (v[min(int(k) + 1, len(v) - 1)] - v[int(k)]) * (k - int(k)), 6)

    prints = {g: [tuple(at([x[k] for i, x in m.items() if kind[i] == g], p) for p in (0.25, 0.5, 0.75)) for k in range(len(KEYS))] for g in set(kind.values())}
    for r in QUERIES["txt_genre_rank"](spark, SF).collect():
        far = {g: sum(abs(x - q[1]) / max(q[2] - q[0], 0.3 * abs(q[1]), 1.0) for x, q in zip(m[r["id"]], p, strict=True)) / len(KEYS) for g, p in prints.items()}
        assert abs(min(far.values()) - r["distance"]) < 1e-4 and abs(far[r["best"]] - r["distance"]) < 1e-4
