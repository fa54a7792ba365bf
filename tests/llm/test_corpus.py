"""The corpus operators against brute force, round trips and held-out rows, and on awkward tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ravelin.llm import chunk_dedup as chunk_module
from ravelin.llm import common, language, packing, pieces, suffix_dedup, token_spans
from ravelin.llm.chunk_dedup import chunk_dedup, chunk_ends
from ravelin.llm.common import table
from ravelin.llm.lm_score import lm_scores
from ravelin.llm.minhash import near_duplicates, shingles, similar
from ravelin.llm.quality_lines import line_rules, repeat_words
from ravelin.llm.queries import QUERIES
from ravelin.llm.tokens import default_vocabulary, ids_of
from ravelin.llm.topk import top_k

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"wort{i * 7919 % 10007}" for i in range(9000))
PASSAGE = " ".join(f"shared{i * 31 % 997}" for i in range(60))


def awkward(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names."""
    texts = [None, "", " \n\t ", "one", "a b c d", LONG, LONG, LONG + " tail", PASSAGE, "x y z " + PASSAGE + " end of it", "é" * 300, "日本語 " * 90, "\0\0", "▁▁ a", "aaaa " * 500]
    rows = [(i if i != 4 else None, t, ["en", "de", None][i % 3], [None, "h"][i % 2], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[5], (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    clashing = ["rid", "z", "n", "key", "label", "row", "digest", "thash", "spans", "length", "salt", "lo", "hi", "times", "host", "target", "ids", "keep", "cid", "size", "rank"]
    return df.withColumns({c: F.lit("clash") for c in clashing})


def text_of(df):
    return {r.doc_id: r.text for r in df.collect()}


OPERATORS = {
    "lines": line_rules,
    "pack": packing.pack,
    "language": lambda d: language.identify(d, language.fit(d)).drop("row"),
    "near": near_duplicates,
    "chunks": chunk_dedup,
    "suffixes": suffix_dedup.suffix_dedup,
    "lm": lambda d: lm_scores(d, d.where("source = 'h'").select("doc_id")),
    "sections": token_spans.section_tokens,
    "pieces": pieces.piece_digests,
    "decoded": lambda d: pieces.decode_pieces(pieces.encode_pieces(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    docs = awkward(spark)
    rows = OPERATORS[name](docs).collect()
    wanted = Counter(r.doc_id for r in docs.collect())
    if name == "pack":
        assert {r.doc_id for r in rows} == set(wanted)
    elif name == "sections":
        assert {r.doc_id for r in rows} == set(wanted) and sum(r.section == 0 for r in rows) == docs.count()
    else:
        assert Counter(r.doc_id for r in rows) == wanted


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_awkward_and_empty(spark, sf, stage):
    name, run = corpus_pipeline.STAGES[stage]
    docs = awkward(spark)
    out = run(spark, docs, sf)
    assert stage == 4 or out.columns == docs.columns
    out.collect()
    assert run(spark, docs.limit(0), sf).collect() == []


def test_stages_compose_lazily_and_side_by_side(spark, sf):
    """A stage's result stays readable whatever runs before it is read."""
    docs = table(spark, sf, "documents")
    (_, quality), (_, languages), (_, near), *_ = corpus_pipeline.STAGES
    want = sorted(r.doc_id for r in common.kept_table(languages(spark, common.kept_table(quality(spark, docs, sf), "q"), sf), "l").collect())
    lazy = languages(spark, quality(spark, docs, sf), sf)
    first, second = quality(spark, docs, sf), quality(spark, docs.limit(50), sf)
    common.sweep(spark, now=True)
    near(spark, docs.limit(20), sf).count()
    assert sorted(r.doc_id for r in lazy.collect()) == want and first.count() >= second.count() > 0


def test_kept_tables_go_when_nothing_reads_them(spark):
    from pathlib import Path

    kept = common.kept_table(spark.range(5).toDF("n"), "five")
    path, derived = Path(kept._kept_path), kept.where("n > 1")
    del kept
    common.sweep(spark, now=True)
    assert path.exists() and derived.count() == 3
    del derived
    for _ in range(20):
        common.sweep(spark, now=True)
        if not path.exists():
            break
    assert not path.exists()


def test_shares_and_salts_follow_the_data(spark, monkeypatch):
    """Whatever their number, results are the same; none grows with the input."""
    docs = awkward(spark)
    want = [sorted(map(repr, f(docs).drop("spans", "kept_bytes", "sequence_id", "offset").collect())) for f in (chunk_dedup, packing.pack)]
    monkeypatch.setattr(chunk_module, "SHARE_BYTES", 1000)
    monkeypatch.setattr(packing, "SALTS", 1)
    monkeypatch.setattr(packing, "SALT_ROWS", 3)
    assert packing.salts_of(10) == 4 and packing.salts_of(100) == 34
    assert [sorted(map(repr, f(docs).drop("spans", "kept_bytes", "sequence_id", "offset").collect())) for f in (chunk_dedup, packing.pack)] == want


def test_packing_is_whole_and_tight(spark, sf):
    docs, path = table(spark, sf, "documents"), default_vocabulary()
    out = QUERIES["op2_packing"](spark, sf).toPandas()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    for doc, t in text_of(docs).items():
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = out[out.doc_id == doc].sort_values("start")
        assert mine.start.tolist() == [0, *mine.length.cumsum()[:-1]] and mine.length.sum() == len(ids) and set(mine.doc_tokens) == {len(ids)}
        assert mine.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)]
    fill = 0
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024
        fill += 0 if (n := int(s.length.sum())) & (n - 1) == 0 else 1024 - n
    assert fill < 0.005 * out.length.sum() and sorted(out.sequence_id.unique()) == list(range(out.sequence_id.nunique()))


@pytest.mark.parametrize("counts", [{100: 1000}, {1: 5000}, {1024: 3, 512: 5, 700: 9, 3: 2}, {n: n % 7 + 1 for n in range(1, 1025)}])
def test_histogram_is_placed_once(counts):
    runs, sequences = packing.pack_histogram(counts, 1024)
    seen, fill = Counter(), Counter()
    for r in runs:
        for rank in range(r.lo, r.hi):
            seen[r.length, rank] += 1
            fill[r.sequence + (rank - r.lo) // r.each] += r.length
    assert set(seen.values()) == {1} and Counter(n for n, _ in seen) == Counter(counts)
    assert set(fill) == set(range(sequences)) and max(fill.values()) <= 1024


def test_ids_are_those_of_the_library():
    """Long texts, added tokens and long white space, which are encoded in parts."""
    from tokenizers import Tokenizer

    own, eot = Tokenizer.from_file(default_vocabulary()), "<|endoftext|>"
    texts = [(LONG + ".\n\n") * 8, eot, f"a {eot} b", f"  {eot}  x{eot}{eot}", "<|endoftext", " " * 4096, " " * 5000 + "x", "\n" * 5000 + "'s", "a" + " " * 6000 + "\n", "\t" * 4097 + eot + " " * 4097 + "é", "\u3000" * 5000 + "日本", "\x1c" * 5000 + "x"]
    for t in texts:
        assert ids_of(t, default_vocabulary()).tolist() == own.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["pack", "lm", "sections"])
def test_two_million_blanks(spark, name):
    docs = spark.createDataFrame([(1, " " * 2_000_000 + "x", "en", "h", 0), (2, " " * 1_000_000, "en", "h", 0)], DOCS)
    rows = OPERATORS[name](docs).collect()
    if name == "pack":
        assert {r.doc_id: r.doc_tokens for r in rows} == {1: 2_000_001, 2: 1_000_001}
    elif name == "lm":
        assert {r.doc_id: r.n_tokens for r in rows} == {1: 2_000_000, 2: 1_000_000}
    else:
        assert {r.doc_id: r.doc_tokens for r in rows} == {1: 2_000_000, 2: 1_000_000} and sum(r.n_tokens for r in rows) == 3_000_000


def test_near_duplicates(spark, sf):
    docs = text_of(table(spark, sf, "documents"))
    base = [f"w{i}" for i in range(400)]  # a ladder of near copies, each like the next only
    for k in range(30):
        docs[10_000 + k] = " ".join(base[:k * 5] + [f"n{i}" for i in range(k * 5)] + base[k * 10:])
    sets = {i: shingles((t or "").encode()) for i, t in docs.items()}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a]) and len(sets[b]) and similar(sets[a], sets[b], 85) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    out = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == root


def test_near_groups_larger_than_a_block(spark, monkeypatch):
    from ravelin.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 3)
    test_near_duplicates(spark, "/root/testdata/sf0.001")


def brute_suffixes(docs, depth):
    counts = Counter(t[i : i + depth] for t in docs.values() for i in range(len(t) - depth + 1))
    out = {}
    for doc, t in docs.items():
        cover = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if counts[t[i : i + depth]] > 1:
                cover[i : i + depth] = b"\1" * depth
        kept = bytes(c for c, gone in zip(t, cover) if not gone)
        out[doc] = (len(t), sum(cover), len([x for x in bytes(cover).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("part", [400, 2])
def test_suffix_dedup(spark, sf, part, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    docs = {r.doc_id: (r.text or "").encode() for r in table(spark, sf, "documents").collect()}
    docs |= {5000 + k: (f"{k} " * 90 + PASSAGE[k:] + f" {k}" * 90).encode() for k in range(40)} | {6000: b"ab" * 400}
    got = suffix_dedup.suffix_dedup(spark.createDataFrame([(i, t.decode()) for i, t in docs.items()], "doc_id long, text string"))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == brute_suffixes(docs, 200)


def test_suffixes_of_repeated_rows_and_null_ids(spark):
    """Rows are places, whatever their ids: repeated rows, one id on two texts, null ids and a text that repeats itself."""
    own = " ".join(f"own{i}" for i in range(60))
    rows = [(1, PASSAGE), (1, PASSAGE), (2, own), (2, "x " + own[7:] + " y"), (None, "null " + PASSAGE), (None, None), (None, "a" * 199), (3, own[:199]), (4, "tail " * 80), (None, "só " + " ".join(f"z{i}" for i in range(90))), (None, "só " + " ".join(f"z{i}" for i in range(90)))]
    want = brute_suffixes({i: (t or "").encode() for i, (_, t) in enumerate(rows)}, 200)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((rows[i][0], *w) for i, w in want.items())


def test_segments_of_long_texts(monkeypatch):
    data = (LONG + " " + LONG).encode()
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    p, first, last, one, *_ = suffix_dedup.anchors(data)
    covered = np.concatenate([np.arange(a, b + 1) for a, b in zip(first, last)])
    assert covered.tolist() == list(range(len(data) - 199)) and set(one) == set(whole[3])


def test_chunks(spark):
    ends = chunk_ends(LONG.encode())
    shifted = chunk_ends(b"inserted " + LONG.encode())
    assert len(set(np.array(ends) + 9) & set(shifted)) > 0.95 * len(ends)
    rows = [(1, "α" * 40 + " " + PASSAGE + " first"), (2, "other words before it " + PASSAGE + " and after"), (3, LONG), (4, "nothing here is held elsewhere")]
    out = {r.doc_id: r for r in chunk_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].n_removed > 0 for i in (1, 2, 3, 4)] == [False, True, False, False]
    assert out[2].n_removed > 0.6 * len(PASSAGE) and PASSAGE.encode()[100:180] not in out[2].kept_bytes


def brute_chunks(rows):
    """Every chunk of every text in plain Python: (id, bytes, removed, spans, digest of what is left) of each row."""
    from ravelin.llm.spans import text_hash

    held: dict[bytes, list] = {}
    cut = []
    for doc, t in rows:
        data = (t or "").encode()
        ends = chunk_ends(data)
        cut.append((doc, data, list(zip([0, *ends], ends))))
        for a, z in cut[-1][2]:
            held.setdefault(data[a:z], []).append((doc, text_hash(data)))
    out = []
    for doc, data, chunks in cut:
        gone, seen = [], set()
        for a, z in chunks:
            at = held[data[a:z]]
            ids = [i for i, _ in at if i is not None]
            own = doc == min(ids) if ids else text_hash(data) == min(h for _, h in at)
            if len(at) > 1 and not (own and doc == (min(ids) if ids else None) and data[a:z] not in seen):
                gone.append([a, z])
            elif len(at) > 1:
                seen.add(data[a:z])
        runs = []
        for a, z in gone:
            if runs and runs[-1][1] == a:
                runs[-1][1] = z
            else:
                runs.append([a, z])
        runs = [r for r in runs if r[1] - r[0] >= 64]
        kept = b"".join(data[i : i + 1] for i in range(len(data)) if not any(a <= i < z for a, z in runs)) if runs else data
        out.append((doc, len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hold", [1 << 17, 50])
def test_chunks_against_brute_force(spark, sf, hold, monkeypatch):
    """All of sf0.001, repeated rows, one id on two texts, null ids and a text that repeats itself, in one block and in many."""
    from ravelin.llm import chunk_dedup as module

    monkeypatch.setattr(module, "HOLD", hold)
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    rows += [*rows[:20], (rows[30][0], rows[31][1]), (None, PASSAGE), (None, PASSAGE), (None, "other " + PASSAGE), (None, None), (7000, ""), (7001, PASSAGE * 3), (7002, "own " + PASSAGE[40:])]
    rows += [(None, "held by none with an id " + " ".join(f"n{i}" for i in range(90))), (None, "told apart by text " + " ".join(f"n{i}" for i in range(90)))]
    got = chunk_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_chunks(rows)


def test_topk(spark, sf):
    rows = table(spark, sf, "embeddings").collect()
    v = {r.vec_id: np.floor(256 * np.array(r.embedding, float)).astype(np.int64) for r in rows}
    want = set()
    for q in v:
        if q % 50 == 0:
            best = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:5]
            want |= {(q, k + 1, c, -s) for k, (s, c) in enumerate(best)}
    assert {tuple(r) for r in QUERIES["op3_topk"](spark, sf).collect()} == want


def test_topk_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None), (6, [None, 1.0]), (None, [9.0, 9.0]), (7, [3.0]), (8, [-1.0, 0.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "query", "rank", "b", "qb")})
    got = [tuple(r) for r in top_k(df, df.where("vec_id % 50 = 0"), 5).orderBy("rank").collect()]
    unit = 256 * 256
    assert got == [(0, 1, 1, 5 * unit), (0, 2, 2, 5 * unit), (0, 3, 7, 3 * unit), (0, 4, 9, 0), (0, 5, 8, -unit)]
    assert top_k(df.limit(0), df.limit(0), 5).collect() == []


def test_topk_of_any_size(spark, monkeypatch):
    """Components from small to 1e8, several shards and blocks, against whole numbers in plain Python."""
    from ravelin.llm import topk

    monkeypatch.setattr(topk, "LEAST_SHARD", 100)
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "FIRST", 20)
    rng = np.random.default_rng(1)
    for scale in (1.0, 1e4, 1e6, 1e8):
        v = [[float(x) for x in row] for row in rng.normal(size=(400, 6)) * min(scale, 1e6)]
        v[7] = v[8] = v[9]
        if scale == 1e8:  # large rows, queries of a size at which scores are still 64-bit integers
            v = [[x / 1e6 if i % 50 == 0 else 100 * x for x in row] for i, row in enumerate(v)]
        rows = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(rows, rows.where("vec_id % 50 = 0"), 5).collect()}
        whole = [[int(np.floor(256 * x)) for x in row] for row in v]
        for q in range(0, 400, 50):
            best = sorted((-sum(a * b for a, b in zip(whole[q], w)), c) for c, w in enumerate(whole) if c != q)[:5]
            assert [got[q, k + 1] for k in range(5)] == [(c, -s) for s, c in best]
    huge = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        top_k(huge, huge, 5).collect()


def test_language_on_held_out_rows(spark):
    from ravelin.llm.common import table

    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n, lo, hi = out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 200 and right > 0.98 and 0 <= lo <= hi <= 1


def test_language_equals_explicit_kernels(spark):
    """Folding landmarks and weights into one matrix changes no score: ridge regression on explicit Nystroem features."""
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    model = language.fit(docs, per_lang=40, landmarks=24)
    rows = language.sample(docs, 40, id_col="doc_id", text_col="text", lang_col="lang").toPandas().sort_values(["nth", "lang"], kind="stable")
    bits = np.unpackbits(np.frombuffer(b"".join(rows.bits), np.uint8).reshape(len(rows), -1), axis=1).astype(float)
    kernel = lambda a, b: a @ b.T / np.sqrt(a.sum(axis=1)[:, None] * b.sum(axis=1)[None, :])
    marks, langs = bits[:24], sorted(rows.lang.unique())
    value, vector = np.linalg.eigh(kernel(marks, marks))
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    x, y = kernel(bits, marks) @ root, np.where(rows.lang.to_numpy()[:, None] == np.array(langs)[None, :], 1.0, -1.0)
    weight = 1 / (len(langs) * rows.groupby("lang").lang.transform("count").to_numpy())
    w = np.linalg.solve(x.T @ (x * weight[:, None]) + language.RIDGE / len(langs) * np.eye(x.shape[1]) / len(rows), x.T @ (y * weight[:, None]))
    out = language.identify(docs.select("doc_id", "text"), model).drop("row").toPandas().set_index("doc_id")
    texts = {r.doc_id: r.text for r in docs.collect() if language.has_letter(r.text)}
    for doc, t in texts.items():
        own = np.zeros(language.BUCKETS, np.uint8)
        language.presence(t, own)
        f = (kernel(own[None].astype(float), marks) @ root @ w)[0]
        assert abs(out.score[doc] - np.clip((1 + f.max()) / 2, 0, 1)) < 1e-3
        assert out.lang_pred[doc] == langs[int(f.argmax())] or np.sort(f)[-1] - np.sort(f)[-2] < 1e-3


def test_tokens_are_attributed_by_the_librarys_offsets(spark, sf):
    """The section of every token by its characters, from the offsets that the tokenizers library gives."""
    from tokenizers import Tokenizer, processors

    own = Tokenizer.from_file(default_vocabulary())
    own.post_processor = processors.ByteLevel(trim_offsets=False)
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    docs |= {9001: "one\ntwo  \n\n three <|endoftext|>\n四 五\n🙂\n", 9002: "a\n" * 50 + "日本\n語" * 9}
    for rule in token_spans.RULES:
        got = token_spans.section_tokens(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), rule=rule)
        have = {(r.doc_id, r.section): (r.n_tokens, r.n_crossing) for r in got.collect()}
        want: dict = {}
        for doc, text in docs.items():
            line = np.cumsum([0, *(c == "\n" for c in text)])[: len(text)] if text else np.zeros(0, int)
            for k in range(int(line[-1]) + 1 if len(line) else 1):
                want[doc, k] = [0, 0]
            for a, z in own.encode(text, add_special_tokens=False).offsets:
                held = Counter(int(x) for x in line[a:z])
                k = {"start": int(line[a]), "end": int(line[z - 1]), "most": min(held, key=lambda s: (-held[s], s))}[rule]
                want[doc, k][0] += 1
                want[doc, k][1] += len(held) > 1
        assert have == {k: tuple(v) for k, v in want.items()}, rule


@pytest.mark.parametrize("hold", [1 << 18, 3])
def test_lm_models_are_counts(spark, sf, hold, monkeypatch):
    from ravelin.llm import lm_score

    monkeypatch.setattr(lm_score, "HOLD", hold)  # blocks of one batch of documents each, and larger ones
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()] + [(9001, "good text"), (9001, "good text"), (9002, None), (None, "no id"), (9003, "<|endoftext|> " * 3)]
    docs, path = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), default_vocabulary()
    chosen = [i for i, _ in rows if i is not None and i % 3 == 0]
    got = lm_scores(docs, spark.createDataFrame([(i,) for i in [*chosen, chosen[0], None]], "doc_id long")).collect()
    n = 50257
    grams = [(i, list(zip([n, *(ids := ids_of(t or "", path).tolist())[:-1]], ids))) for i, t in rows]

    def model(use):
        pairs = Counter(g for i, own in grams if use(i) for g in own)
        h, w = Counter(), Counter()
        for (a, b), c in pairs.items():
            h[a] += c
            w[b] += c
        total = sum(pairs.values())
        return lambda g: -np.log((pairs[g] + 20 * (w[g[1]] + 1) / (total + n)) / (h[g[0]] + 20))

    target, background = model(set(chosen).__contains__), model(lambda i: True)
    want = Counter((i, len(own), *((round(float(np.mean([m(g) for g in own])), 6) for m in (target, background)) if own else (None, None))) for i, own in grams)
    assert Counter((r.doc_id, r.n_tokens, *(x if x is None else round(x, 6) for x in (r.target_loss, r.background_loss))) for r in got) == want
    assert all(r.score is None if not r.n_tokens else abs(r.score - (r.target_loss - r.background_loss)) < 1e-12 for r in got)


def test_sections(spark, sf):
    text = "one two\nthree\n\n\nfour é日本 five\n"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(default_vocabulary()).encode(text, add_special_tokens=False)
    first, end = token_spans.token_spans(text, default_vocabulary())
    assert len(first) == len(own.ids) and [text[a:z] for a, z in zip(first, end)][:3] == ["one", " two", "\n"]
    starts = token_spans.lines_of(text)
    assert [text[a:z] for a, z in zip(starts, [*starts[1:], len(text)])] == text.splitlines(keepends=True)
    for rule in token_spans.RULES:
        at, cross = token_spans.attribute(np.array([0, 3, 5]), np.array([3, 9, 6]), np.array([0, 4, 8]), rule)
        assert cross.tolist() == [False, True, False] and at.tolist() == [0, {"start": 0, "end": 2, "most": 1}[rule], 1]
    out = QUERIES["op8_token_counts"](spark, sf).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("m"), F.max("char_end").alias("z"))
    docs = text_of(table(spark, sf, "documents"))
    for r in out.collect():
        assert r.n == r.m == len(ids_of(docs[r.doc_id] or "", default_vocabulary())) and r.z == len(docs[r.doc_id] or "")


def test_pieces_equal_the_library(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["", " ", "  a  b\n\n c ﬁ\t", "x" * 500, "the " * 300, "日本語テキスト 🙂 á", "▁▁a", "aaaaaaaaa bbbbb       ccc", "<s> </s> <0x0A>", "\0a\0", LONG, "thonthon" * 60]
    texts = odd + [t for t in text_of(table(spark, sf, "documents")).values() if t]
    v = pieces.vocabulary(pieces.default_model())
    got = pieces.encode_batch(texts, v)
    assert [x.tolist() for x in got] == library.encode(texts)
    assert all(pieces.decode(x, v) == t.replace("▁", " ") for x, t in zip(got, texts))


def test_repeat_words():
    for words in ("a b c a b c", "a a a a", "a b c d", "", "x y z q x y z w x y z"):
        w = words.encode().split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        assert repeat_words(w) == len(hit)


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    own = lambda i, n: " ".join(f"own{i}x{j}" for j in range(n))
    menu = " ".join(f"menu{i}" for i in range(65))
    rows = [(i, f"{menu}\n{own(i, 300)}", "h") for i in range(60)] + [(60 + i, f"{menu}\n{own(i, 5)}", "h") for i in range(5)]
    rows += [(100 + i, own(7, 80), "h") for i in range(100)] + [(300, f"{menu}\n{own(1, 5)}", "elsewhere")]
    out = {r.doc_id: r for r in line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=True).collect()}
    assert set(out) == {*range(60), *range(100, 200), 300} and not any(menu[:20] in out[i].clean_text for i in range(60))
    assert menu[:20] in out[300].clean_text  # another host


def test_pipeline_keeps_one_of_each_group(spark, sf):
    docs = table(spark, sf, "documents")
    kept = corpus_pipeline.near_dedup(spark, docs.unionByName(docs), sf)
    want = {r.component_id for r in near_duplicates(docs, percent=corpus_pipeline.NEAR_PERCENT).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_pipeline_stages_follow_each_other(spark, sf):
    docs = table(spark, sf, "documents")
    ids, columns = {r.doc_id for r in docs.collect()}, docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= ids and docs.where("n_chars <> char_length(text)").isEmpty()
        ids = now
    assert corpus_pipeline.packing(spark, docs, sf).select("doc_id").distinct().count() == len(ids)
