"""Personal data, source divergence and conversation repair against brute force, planted cases and awkward tables."""

import hashlib
import random
import re
import sys
import zlib
from collections import defaultdict
from functools import cache
from itertools import pairwise

import duckdb
import numpy as np
import pytest

from ravelin.llm import conversation, divergence, personal
from ravelin.llm.common import table
from ravelin.llm.oracle import ORACLE
from ravelin.llm.queries import QUERIES

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_rules(text):
    out = []
    for k, (name, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")), "phone": lambda: 9 <= len(d) <= 15,
                "card": lambda: 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
            }[name]()
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def said(spans):
    return ",".join(f"{personal.KINDS[k]}:{lo}:{hi}" for lo, k, hi in spans)


def test_rules_equal_the_patterns():
    dice = random.Random(1)
    bits = ["a", ".", "@", "-", "%", "1", "2", "9", " ", "+", "(", ")", "é", "b.c", "@a.b", "10.2.3.4", "4111111111111111", "\n", "555"]
    for _ in range(20_000):
        text = "".join(dice.choice(bits) for _ in range(dice.randint(0, 25)))
        assert personal.base_spans(text) == by_rules(text), text


@pytest.mark.parametrize("text", ["a" * 2_000_000, "1" * 2_000_000, "a@" * 500_000, "+1" + " " * 1_000_000, "1.2.3.4 " * 100_000])
def test_rules_on_very_long_texts(text):
    base = personal.base_spans(text)
    assert len(base) == (100_000 if text[:2] == "1." else 0)
    personal.instances(text, base)


def test_personal_data_of_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    rows = QUERIES["op11_personal_data"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = by_rules(docs[r.doc_id])
        assert [r[f"n_{k}"] for k in personal.KINDS] == [sum(s[1] == i for s in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest()
        assert set(filter(None, said(want).split(","))) <= set(filter(None, r.spans.split(",")))
        assert len(r.spans.split(",")) - (r.spans == "") == len(want) + r.n_added


def bootstrapped(texts, least_seeds=personal.LEAST_SEEDS, least=personal.LEAST_CONFIDENCE, rounds=personal.ROUNDS):
    """The method with dictionaries: the spans of each text."""
    places, edges, known = [], {}, set()
    for i, text in enumerate(texts):
        for lo, hi, kinds, seed, value, patterns in personal.instances(text, by_rules(text)):
            options = [(seed - 1, value)] if seed else [(k, f"{k}:{value}") for k in range(4) if kinds >> k & 1] or [(None, value)]
            for nth, (kind, key) in enumerate(options):
                places.append((i, lo, hi, kind, key, seed))
                known |= {(key, kind)} if seed else set()
                for p in patterns:
                    old = edges.get((p, key), (None, 0, 9))
                    edges[p, key] = (kind if old[0] is None else old[0], max(seed, old[1]), min(nth, old[2]))
    size = defaultdict(int)
    for (p, _), e in edges.items():
        size[p] += e[2] == 0
    belief = {k: 1.0 for k, _ in known}
    for _ in range(rounds):
        positive = defaultdict(float)
        for (p, key), (kind, *_) in edges.items():
            if kind is not None:
                positive[p, kind] += belief.get(key, 0)
        trust = {pk: v / (size[pk[0]] + 1) for pk, v in positive.items() if v >= least_seeds and v / (size[pk[0]] + 1) >= least}
        doubt = defaultdict(lambda: 1.0)
        for (p, key), (kind, seed, _) in edges.items():
            if not seed and (p, kind) in trust:
                doubt[key] *= 1 - trust[p, kind]
        belief = {k: 1.0 for k, _ in known} | {k: 1 - d for k, d in doubt.items() if (k, None) not in known and k not in {x for x, _ in known}}
    best = {}
    for i, lo, hi, kind, key, seed in places:
        if not seed and kind is not None and key in belief:
            best[i, lo, hi] = max(best.get((i, lo, hi), (-1, 0)), (belief[key], -kind))
    out = [by_rules(t) for t in texts]
    for (i, lo, hi), (_, kind) in best.items():
        out[i] = sorted([*out[i], (lo, -kind, hi)])
    return out


def planted():
    dice, words = random.Random(3), "the cat runs over blue hills and then sleeps".split()

    def some(n):
        return " ".join(dice.choices(words, k=n))

    texts = [f"{some(6)} call me at tel: +1 (212) 555-{1000 + i} {some(1)} bye" for i in range(90)]
    texts += ["please call me at tel: 212 555 7777 thanks", "elsewhere we saw 212-555-7777 again, twice", "but 12 cats and 212 555 8888 dogs"]
    texts += [f"write to mail: user{i}@example{i}.org now" for i in range(10)] + ["write to mail: someone[at]example[dot]com soon"]
    # a chain: a form that seeds never have is found by its cue, and a second cue by what the first one found
    texts += [f"call me at tel: 212 555 {2000 + i} now" for i in range(14)] + [f"ring {some(1)} fax: 212 555 {2000 + i} today" for i in range(14)]
    texts += ["ring us fax: 212 555 9999 today"] + [f"the sum is {some(1)} {i * 7919} of {i}" for i in range(40)]
    return texts + [texts[0]] * 5 + ["", "日本語 12 é 4111 1111 1111 1111 @ 7"]


def test_context_finds_unseen_identifiers(spark):
    texts = planted()
    rows = personal.identifiers(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got, want = {r.doc_id: r.spans for r in rows}, bootstrapped(texts)
    assert got == {i: said(s) for i, s in enumerate(want)}
    by_text = {texts[r.doc_id]: r for r in rows}
    for text in ("please call me at tel: 212 555 7777 thanks", "elsewhere we saw 212-555-7777 again, twice", "write to mail: someone[at]example[dot]com soon", "ring us fax: 212 555 9999 today"):
        assert by_text[text].n_added == 1
    assert by_text["but 12 cats and 212 555 8888 dogs"].n_added == 0 and not any(r.n_added for t, r in by_text.items() if t.startswith("the sum"))


def test_awkward_personal_data(spark):
    rows = [(1, None, "x"), (1, "", None), (None, "a@b.co", "y"), (None, "a@b.co", "y"), (2, "é 1.2.3.4 日 +1 (212) 555-1234 x 4111-1111-1111-1111" + " z" * 200_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string").selectExpr("*", "1 AS rid", "2 AS key", "3 AS start", "4 AS found", "5 AS base")
    got = sorted((r.doc_id or 0, r.spans, r.n_added) for r in personal.identifiers(docs).collect())
    assert got == [(0, "email:0:6", 0), (0, "email:0:6", 0), (1, "", 0), (1, "", 0), (2, "ip:2:9,phone:12:29,card:32:51", 0)]
    assert personal.identifiers(docs.limit(0)).collect() == []


DOCS = "doc_id long, text string, lang string, source string"


def divergence_rows():
    dice = random.Random(1)
    odd = [None, "", "Zeta eta", "É tu é", "a b c "]
    word = lambda: dice.choice(["alpha", "Beta", "gamma", f"x{dice.randint(0, 80)}", "é漢", "it\x0bb", "a-b_c"])
    rows = [
        (i, dice.choice(odd) if dice.random() < 0.2 else " ".join(word() for _ in range(dice.randint(0, 30))), dice.choice(["en", "de", None, "", "only"]), dice.choice([None, "", f"s{dice.randint(0, 9)}"]))
        for i in range(1500)
    ]
    return rows + rows[:300] + [(1, "w " * 100_000, "en", "big"), (5, "q", "rare", "r1"), (6, "q", "rare", "r2"), (7, None, "rare", None)]


def asked(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return sorted(con.sql(ORACLE["op12_source_divergence"]).fetchall())


@pytest.mark.parametrize("parts", ["1", "9"])
def test_divergence_equals_its_sql(spark, parts):
    docs = spark.createDataFrame(divergence_rows(), DOCS)
    clash = docs.selectExpr("*", "'c' AS term", "'c' AS n", "'c' AS v", "'c' AS z", "'c' AS p", "'c' AS path", "'c' AS held")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted(map(tuple, divergence.audit(clash).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == asked(docs) and {r[0] for r in got} == {"", "en", "de", "only", "rare"}
    assert [r for r in got if r[0] == "rare"] == [("rare", *r) for r in [("", "pair", "r1", 0, 1), ("", "pair", "r2", 0, 2), ("r1", "pair", "", 0, 1), ("r1", "pair", "r2", 0, 2), ("r2", "pair", "", 0, 1), ("r2", "pair", "r1", 0, 2)]]


def test_divergence_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_beyond_64_bits(spark):
    one = spark.createDataFrame([(10**13, 3 * 10**13, 10**6)], "c long, n long, v long")
    from pyspark.sql import functions as F

    assert one.select(divergence._share(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 5 * 10**6)


def cheapest(rows):
    """A conversation's figures by trying all edits. rows: (turn, role, text) in order."""
    seen, faults, count = set(), [], [0] * 4
    for _, role, text in rows:
        inner = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not inner else 2 if (role, text) in seen else 3 if inner[-1] not in ".!?" else 0)
        seen.add((role, text))
        count[faults[-1]] += 1

    def may(state, c):
        return c in {"": "su", "s": "u", "u": "a", "a": "u"}[state]

    @cache
    def go(i, state, put):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if put < 3:
            found += [(2 + x[0], "I" + x[1]) for c in "ua" if may(state, c) and (x := go(i, c, put + 1))]
        if i < len(rows):
            x = go(i + 1, state, 0)
            found.append((3 + x[0], "D" + x[1]))
            if faults[i] in (0, 3):
                more, c = int(faults[i] == 3), rows[i][1][:1]
                if c and c in "sua" and may(state, c) and (x := go(i + 1, c, 0)):
                    found.append((more + x[0], "K" + x[1]))
                found += [(2 + more + x[0], "R" + x[1]) for c in "ua" if may(state, c) and (x := go(i + 1, c, 0))]
        return min(found) if found else (10**9, "")

    sys.setrecursionlimit(max(10_000, 8 * len(rows)))
    cost, letters = go(0, "", 0)
    state, out, i = "", [], 0
    for e in letters:
        role = "assistant" if state == "u" else "user"
        if e != "D":
            out.append(f"{rows[i][1] if e == 'K' else role}:{'' if e == 'I' else rows[i][2]}")
            state = out[-1][0]
        i += e != "I"
    assert re.fullmatch(r"(s?(ua)+)?", "".join(x[0] for x in out))
    have = [t for t, *_ in rows if t is not None]
    gaps = max(have) - min(have) + 1 - len(set(have)) if have else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairwise(rows))
    return gaps, *count[1:], illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest()


def harmed(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = by[conv]
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1], zlib.crc32(r[2].encode()))) for c, x in by.items()}


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversation_rows():
    dice = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "user", "assistant"], ["Hi.", "no", "  ", None, "What?", "ok then", "Hi.", "yes!"]
    rows = [(c, t, dice.choice(roles), dice.choice(texts)) for c in [None, *range(40)] for t in [None, *range(dice.randint(1, 14))]]
    rows += [(99, k, dice.choice(roles[:3]), dice.choice([f"a{k}.", f"b{k}"])) for k in range(250)]
    rows += [(77, 5, "user", "Hi.")] * 50 + [(78, None, "x", "y")] * 30 + [(79, 1, "user", "long " * 100_000), (79, 2, "assistant", "Ok.")]
    rows += [(c, 0, "user", "x") for c in range(1000, 1100)]  # some of these lose their only row
    return rows + [rows[4]] * 3


@pytest.mark.parametrize("parts,chunk,block", [(4, 4096, 4), (40, 7, 3), (3, 5, 1)])
def test_repair_equals_trying_all_edits(spark, parts, chunk, block):
    rows = conversation_rows()
    want = {c: cheapest(r) for c, r in harmed(rows).items()}
    docs = spark.createDataFrame(rows, CONVERSATIONS).repartition(3).selectExpr("*", "1 AS seg", "2 AS pos", "3 AS sum", "4 AS at", "5 AS done", "6 AS audit")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = conversation.repair(docs, chunk_rows=chunk, block=block).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want
    gone = [r for r in got if r.conv_id is not None and r.conv_id >= 1000 and r.audit == ""]
    assert gone and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone)


def test_repair_of_conversations(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    want = {c: cheapest(r) for c, r in harmed(rows).items()}
    assert {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, sf).collect()} == want


def test_repair_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(ORACLE["op13_conversation_repair"])
    got = QUERIES["op13_conversation_repair"](spark, sf)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_repair_of_nothing(spark):
    assert conversation.repair(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def test_block_tables_equal_single_steps():
    one, four, dice = conversation.tables(1), conversation.tables(4), np.random.default_rng(5)
    for n in (0, 1, 3, 4, 5, 50):
        symbols = dice.integers(0, conversation.SYMBOLS, n).astype(np.uint8)
        for v in range(len(one.vectors)):
            assert one.cost_of(symbols, v)[:2] == four.cost_of(symbols, v)[:2] == tuple(int(x[v]) for x in four.step(symbols))
            assert all(one.traced(symbols, x, v) == four.traced(symbols, x, v) for x in range(4))
