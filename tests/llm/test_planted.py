"""Planted cases: near copies, passages that repeat, clean rows among them, and what a second run does."""

import random

import pytest
from pyspark.sql import functions as F

from ravelin.llm import components, minhash, packing
from ravelin.llm.chunk_dedup import chunk_dedup
from ravelin.llm.common import forget, kept_table, shared_dir
from ravelin.llm.minhash import near_duplicates
from ravelin.llm.quality_lines import line_rules
from ravelin.llm.suffix_dedup import suffix_dedup

RNG = random.Random(3)


def words(n):
    return ["".join(RNG.choice("aeioulnrst") for _ in range(RNG.randint(3, 8))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "h", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_copies_are_linked_and_others_are_not(spark):
    texts, want = [], []
    for g in range(30):
        base = words(300)
        for copy in range(1 + g % 3):
            w = list(base)
            for _ in range(copy * 2):
                w[RNG.randrange(300)] = "changed"
            want.append(len(texts) - copy)
            texts.append(" ".join(w))
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_case_and_spacing_make_exact_copies(spark):
    t = " ".join(words(50))
    got = near_duplicates(frame(spark, [t, t.upper(), t.replace(" ", "\n "), t + " more of it and more"])).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == [0, 0, 0, 0] and [r.kept for r in got] == [True, False, False, False]


def test_a_large_group_of_copies_stays_one_class(spark):
    t, other = " ".join(words(100)), [" ".join(words(100)) for _ in range(20)]
    got = near_duplicates(frame(spark, [t] * 500 + other)).groupBy("component_id").count().orderBy("component_id").collect()
    assert [r["count"] for r in got] == [500] + [1] * 20


@pytest.mark.parametrize("dedup", [chunk_dedup, suffix_dedup])
def test_passages_go_and_clean_documents_stay(spark, dedup):
    passage = words(120)
    dirty = [" ".join(words(200) + passage + words(200)) for _ in range(10)]
    clean = [" ".join(words(400)) for _ in range(30)]
    out = {r.doc_id: r for r in dedup(frame(spark, dirty + clean)).collect()}
    cut = [out[i].n_removed for i in range(10)]
    assert all(n > 400 for n in cut[1:]) and all(out[i].n_removed == 0 for i in range(10, 40))
    assert (cut[0] > 400) == (dedup is suffix_dedup)  # chunks keep their first place


def test_clean_copies_are_not_depleted_by_their_own_number(spark):
    t = "\n".join(" ".join(words(30)) for _ in range(5))
    near = [t + "\n" + " ".join(words(4)) for _ in range(40)]
    rest = ["\n".join(" ".join(words(20)) for _ in range(4)) for _ in range(600)]
    out = line_rules(frame(spark, [t] * 300 + near + rest))
    assert out.where("NOT kept").isEmpty()


def test_results_do_not_change_from_run_to_run(spark):
    d = frame(spark, [" ".join(words(RNG.randint(1, 800))) for _ in range(60)])
    for f in (near_duplicates, packing.pack, suffix_dedup):
        a, b = (sorted(map(tuple, f(x).drop("rid", "label", "spans", "kept_bytes").collect())) for x in (d, d.repartition(7)))
        assert f is packing.pack or a == b
    assert sorted(packing.pack(d).select("doc_id", "start", "length", "ids_crc32").collect()) == sorted(packing.pack(d.repartition(5)).select("doc_id", "start", "length", "ids_crc32").collect())


def test_components_of_paths_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + (i + 1) % 20) for i in range(20)] + [(500, 501 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(20)} | {500 + i: 500 for i in range(31)}


def test_kept_tables_lie_in_the_shared_folder_and_can_be_deleted(spark):
    t = kept_table(spark.range(5).withColumn("x", F.lit(1)), "five")
    assert t._kept_path.startswith(shared_dir(spark)) and t.count() == 5 and t.inputFiles()
    forget(t)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(t._kept_path)


def test_repeated_rows_are_judged_alike_by_the_quality_stage(spark, sf):
    import corpus_pipeline
    from ravelin.llm.common import table

    docs = table(spark, sf, "documents")
    once = sorted(r.doc_id for r in corpus_pipeline.quality(spark, docs, sf).collect())
    twice = sorted(r.doc_id for r in corpus_pipeline.quality(spark, docs.unionByName(docs), sf).collect())
    assert twice == sorted(once * 2)


def test_repeated_rows_keep_their_chunks(spark):
    docs = frame(spark, [" ".join(words(300)) for _ in range(8)])
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = chunk_dedup(docs.unionByName(docs)).collect()
    assert len(got) == 16 and all(bytes(r.kept_bytes).decode() == texts[r.doc_id] for r in got)


def test_rows_without_an_id_keep_what_no_other_row_holds(spark):
    passage, alone, held = " ".join(words(200)), " ".join(words(200)), " ".join(words(200))
    rows = [(None, alone), (None, alone), (None, "one " + passage), (None, "two " + passage), (None, held), (7, held)]
    got = [(r.doc_id, r.n_bytes, bytes(r.kept_bytes).decode()) for r in chunk_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [t for _, _, t in got].count(alone) == 2
    shared = sorted(len(t) for i, n, t in got if i is None and n == len(passage) + 4)
    assert shared[1] == len(passage) + 4 and shared[0] < 0.2 * len(passage)
    assert [t for i, _, t in got if i == 7] == [held] and (None, len(held), "") in got


def test_thresholds_follow_the_similarity():
    assert minhash.thresholds(85) == (16, 1656, 34) and minhash.thresholds(100) == (32, 2048, 64)
    assert all(a < b for a, b in zip(minhash.thresholds(80), minhash.thresholds(85), strict=True))


def test_near_copies_between_80_and_85_percent_leave_the_pipeline(spark, sf):
    import corpus_pipeline

    texts = []
    for _ in range(40):
        base = words(400)
        texts += [" ".join(base), " ".join(base[:330] + words(35) + base[365:])]
    sets = [minhash.shingles(t.encode()) for t in texts]
    assert all(minhash.similar(a, b, 80) and not minhash.similar(a, b, 85) for a, b in zip(sets[::2], sets[1::2], strict=True))
    docs = frame(spark, texts)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == list(range(0, 80, 2))
    assert near_duplicates(docs).where("NOT kept").isEmpty()  # op7 keeps its 85


FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar",
    "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti",
]


def test_unlearned_languages_leave_the_pipeline_and_clean_documents_stay(spark):
    import corpus_pipeline
    from ravelin.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source", "n_chars")
    planted = spark.createDataFrame([(10**6 + i, t, None, "h", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    stay = {r.doc_id for r in corpus_pipeline.languages(spark, docs.unionByName(planted), "").collect()}
    assert not [t for i, t in enumerate(FOREIGN) if 10**6 + i in stay]
    clean = {r.doc_id for r in docs.collect()}
    assert len(clean & stay) > 0.99 * len(clean)
