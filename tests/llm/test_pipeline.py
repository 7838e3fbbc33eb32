"""Every stage of the pipeline against brute force, on tables with nulls, repeated ids, repeated rows and clashing columns."""

from __future__ import annotations

import random
import re
import struct
import zlib
from collections import Counter

import pytest

from .test_operators import WORDS, components_by_force, leaks_by_force, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, findings string, masked string, component long"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """(folder, rows): labels and benchmark as tables, documents as rows."""
    rng, folder = random.Random(51), tmp_path_factory.mktemp("sf")
    item = " ".join(rng.choice(WORDS) for _ in range(20))
    base = prose(rng, 60)
    bad = ["gruvnak", "zebbish", "plorkdum"]
    texts, labels = [], []
    for i in range(240):
        w = prose(rng, rng.randint(30, 90)).split()
        if i % 4 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append((i, 1, int(i % 4 == 0)))
    rows = [(i, t) for i, t in enumerate(texts)]
    near = base.split()
    near[50] = "changed"
    rows += [(300, base), (301, " ".join(near)), (301, prose(rng, 40)), (None, base), (None, None), (None, ""), (302, None), (302, None), (303, f"{prose(rng, 10)} {item} {prose(rng, 10)}"), (303, prose(rng, 30))]
    rows += [(304, 'the token = "0123456789abcdef0123456789abcdef01234567" is'), (305, prose(rng, 4000)), (305, "short text"), (305, "short text")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), [(d, t, "en", "s", len(t or ""), 0.5, 7, "f", "m", 3) for d, t in rows], item


def counted(df):
    return Counter(map(tuple, df.collect()))


def test_stages_keep_columns_and_take_empty_tables(spark, made):
    import corpus_pipeline as P

    folder, rows, _ = made
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_toxicity_stage(spark, made):
    import corpus_pipeline as P
    from lexmill.llm.toxicity import fit

    folder, rows, _ = made
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    score = fit(docs, spark.read.parquet(f"{folder}/labels.parquet")).scorer()
    kept = counted(P.toxicity(spark, docs, folder))
    assert kept == Counter(r for r in rows if score(r[1] or "") < 0.3)
    toxic = [r for r in rows if r[0] is not None and r[0] < 240 and r[0] % 4 == 0]
    assert sum(kept[r] for r in toxic) < 0.1 * len(toxic) and sum(kept[r] for r in rows if r not in toxic) > 0.95 * (len(rows) - len(toxic))


def test_jaccard_stage(spark, made):
    import corpus_pipeline as P

    folder, rows, _ = made
    groups: dict = {}
    for i, n, c in components_by_force([r[1] for r in rows]):
        groups.setdefault((c if n else ("alone", i)), []).append(rows[i])
    got = counted(P.jaccard(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder))
    assert sum(got.values()) == len(groups)
    for members in groups.values():
        least = min(members, key=lambda r: (r[0] is None, r[0] or 0))[0]
        assert sum(1 for r in {*members} if got[r]) == 1 and any(got[r] for r in members if r[0] == least)


def test_decontamination_stage(spark, made):
    import corpus_pipeline as P

    folder, rows, item = made
    found = {i for i, _ in leaks_by_force([r[1] for r in rows], [(1, item)])}
    got = counted(P.decontaminate(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder))
    assert found and got == Counter(r for i, r in enumerate(rows) if i not in found)


def test_secrets_stage(spark, made):
    import corpus_pipeline as P

    folder, rows, _ = made
    secret = "0123456789abcdef0123456789abcdef01234567"
    want = Counter((d, t.replace(secret, "<secret>"), *x[:2], len(t.replace(secret, "<secret>")), *x[3:]) if t and secret in t else (d, t, *x) for d, t, *x in rows)
    assert counted(P.secrets(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder)) == want


def test_packing_stage(spark, made):
    from tokenizers import Tokenizer

    import corpus_pipeline as P
    from lexmill.llm.queries import tokenizer_path

    folder, rows, _ = made
    tok, want = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json")), Counter()
    for d, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.update((d, k, a, len(ids[a : a + 2048]), zlib.crc32(struct.pack(f"<{len(ids[a : a + 2048])}I", *ids[a : a + 2048]))) for k, a in enumerate(range(0, len(ids), 2048)))
    got = P.packing(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins: dict = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in bins.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= 1.05 * sum(r["length"] for r in got) / 2048 + 1
    assert re.match("packing", P.STAGES[-1][0])
