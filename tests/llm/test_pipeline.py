"""The pipeline's stages, one after the other, against what each must keep."""

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_every_stage_reads_what_the_one_before_kept(spark):
    import corpus_pipeline as P
    from rastrel.llm import decontaminate, simhash, sstable
    from rastrel.llm.common import table

    docs = table(spark, SF, "documents")
    names, kept = docs.columns, docs
    counts = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == names, name
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0.6 * counts[0]
    assert decontaminate.overlaps(kept, table(spark, SF, "benchmark")).count() == 0
    assert simhash.near_copies(kept).filter("doc_id <> component_id").count() == 0
    last = P.STAGES[-1][1](spark, kept, SF)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in kept.collect())
    whole = P.run(spark, SF)
    assert whole.agg(F.sum("n_tokens")).first() == sstable.encode(kept).agg(F.sum("n_tokens")).first()


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= names


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_rows_of_all_sorts(spark, docs, no_docs, stage):
    """Nulls, empty and long texts, repeated rows, columns of all names; an empty table."""
    import corpus_pipeline as P

    run = P.STAGES[stage][1]
    kept = run(spark, docs, SF).cache()
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert kept.filter("doc_id IS NULL").count() == docs.filter("doc_id IS NULL").count()
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    if stage == 1:
        assert 7 in ids and not {100, 101, 102, 103, 104} & set(ids) and ids.count(3) == 3 and len({120, 121, 122} & set(ids)) == 1
    else:
        assert {7, 100, 104, 126} <= set(ids)
    none = run(spark, no_docs, SF)
    assert none.columns == docs.columns and none.count() == 0


def test_near_copies_of_the_given_documents_equal_brute_force(spark):
    """Components over all pairs of five-word shingle sets of similarity 0.8."""
    from rastrel.llm import simhash
    from rastrel.llm.common import table

    docs = table(spark, SF, "documents")
    sets, of = {}, {}
    for r in docs.select("doc_id", "text").collect():
        own = frozenset(simhash.grams((r.text or "").encode(), 5))
        of[r.doc_id] = sets.setdefault(own, len(sets))
    shingles = {k: s for s, k in sets.items()}
    name = {k: min(i for i, o in of.items() if o == k) for k in shingles}
    changed = True
    links = [(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(name[a], name[b])
            changed |= name[a] != low or name[b] != low
            name[a] = name[b] = low
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: name[k] for i, k in of.items()}



def test_shards_follow_the_mix(spark):
    """Tokens are stored in the order that the mixing stage has dealt, whichever way its files are scanned."""
    import corpus_pipeline as P
    from rastrel.llm import mixing
    from rastrel.llm.common import materialize, table

    docs = table(spark, SF, "documents")
    for _, stage in P.STAGES[:-2]:
        docs = materialize(stage(spark, docs, SF), "test")
    mix = [r.doc_id for r in mixing.slots(docs).orderBy("slot", "place").collect()]
    assert mix != sorted(mix)
    stored = [r.doc_id for r in P.run(spark, SF).orderBy("start").collect()]
    assert stored == mix
    few = docs.limit(40).cache()
    mixed = P.STAGES[-2][1](spark, few, SF).repartitionByRange(8, "doc_id").cache()  # rows that are no files
    stored = [r.doc_id for r in P.STAGES[-1][1](spark, mixed, SF).orderBy("start").collect()]
    assert stored == [r.doc_id for r in mixed.collect()]


def test_shards_in_an_order_of_their_own(spark, tmp_path):
    from rastrel.llm import sstable, tokens

    rows = [(7, "b b", 3), (None, "no id", 1), (7, "a", 0), (2, None, 2), (-5, "x " * 40000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, at long")
    manifest = sstable.write_shards(df, f"file://{tmp_path}/s", order=[F.col("at")]).orderBy("part", "roll").collect()
    shards = [sstable.Shard(r.path) for r in manifest]
    assert [i for s in shards for i, _, _ in s] == [7, None, 2, 7, -5]
    encoder = tokens.Encoder(tokens.path(tokens.WORD_BPE))
    for doc_id in (7, None, 2, -5, 3):
        want = [[*encoder.ids(t or ""), sstable.END] for i, t, _ in sorted(rows, key=lambda x: x[2]) if i == doc_id]
        assert [x.tolist() for s in shards for x in s.get(doc_id)] == want
    got = sstable.read_shards(spark.createDataFrame(manifest)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [7, None, 2, 7, -5] and got[0].start == 0 and got[-1].start == sum(r.n_tokens for r in got[:-1])
