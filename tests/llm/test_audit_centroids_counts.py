"""Operators 11 to 13 against brute force, on awkward tables: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re

import pytest

from waymark.llm import centroids, filter_audit, token_counts
from waymark.llm.queries import oracle_sql, queries, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = tokenizer_path("byte_bpe_50k.json")
CLASH = "n long, digest string, part string, step int, first string, v string, cluster string, chunk string, rows string"
SAME = (7, "d", "p", 3, "f", "v", "c", "k", "r")


def brief(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows_of(found):
    return collections.Counter(tuple(brief(r[c]) for c in sorted(found.columns)) for r in found.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    some = ["alpha", "Beta", "GAMMA", "de#lta", "eps", "zeta", "éta", "数"]
    made = []
    for i in range(60):
        pool = some[: 2 + i % 7] + [f"w{k}" for k in range(i % 5 * 20)]
        made.append((i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 160))), f"s{i % 3}"))
    made += [(70, made[5][1], "s1"), (71, made[5][1], "s2"), (3, made[5][1], "s0"), (71, made[5][1], "s2")]
    made += [(80, None, "s1"), (81, "", None), (82, " \n", ""), (None, made[5][1], "s1"), (None, None, None), (83, "A B " * 30_000, "s1"), (84, "x$", None)]
    return made


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(*t, *SAME) for t in texts], f"doc_id long, text string, source string, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], f"doc_id long, text string, source string, {CLASH}")


LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(70, 1, 1), (70, 0, None), (None, 1, 1), (71, None, None), (5, 1, 0)]


# --- 11


def audited(texts, labels):
    """Every document through every order, one filter after the other."""
    quality, toxic = collections.defaultdict(set), collections.defaultdict(set)
    for i, q, t in labels:
        if i is not None:
            quality[i].add(q)
            toxic[i].add(t)
    least = {}
    for i, t, _ in texts:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    count, parts = collections.Counter(), set()
    for i, t, part in texts:
        t, part = t or "", part or ""
        parts.add(part)
        ws = WORD.findall(t)
        fails = set()
        fails |= {"A"} if len(ws) < 50 else set()
        fails |= {"B"} if 100 * len(set(ws)) < 65 * len(ws) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else set()
        fails |= {"D"} if re.search("[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and t in least and least[t] < i else set()
        for order in itertools.permutations("ABCDE"):
            alive = True
            for step, x in enumerate(order, 1):
                at = (part, "".join(order), step)
                if x in fails:
                    count[at, "removed" if alive else "redundant"] += 1
                    count[at, "unique_fails"] += len(fails) == 1
                    count[at, "good_lost"] += alive and i is not None and 1 in quality[i]
                    count[at, "toxic_lost"] += alive and i is not None and 1 in toxic[i]
                    count[part, x] += alive
                    alive = False
                count[at, "kept"] += alive
    return {
        (part, "".join(order), step): (*(count[(part, "".join(order), step), c] for c in filter_audit.COUNTS), count[part, order[step - 1]])
        for part in parts for order in itertools.permutations("ABCDE") for step in range(1, 6)
    }


def test_audit_matches_a_replay_document_by_document(spark, docs, texts):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, labels)
    assert found.columns == ["part", "filter_order", "step", *filter_audit.COUNTS, "shapley"]
    got = found.collect()
    assert {(r[0], r[1], r[2]): tuple(r[3:]) for r in got} == audited(texts, LABELS)
    assert len(got) == 4 * 600


def test_audit_of_no_documents_and_of_no_labels(spark, docs, none, texts):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in filter_audit.audit(docs, labels).collect()}
    assert got == audited(texts, [])


# --- 12


def lloyd(rows, k, rounds, seed="3:"):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x * 1024) < centroids.RANGE for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    at = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(at)), key=lambda j: (far(v, at[j]), j))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)].append(v)
        at = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(at)]
    told = [(i, near(v), far(v, at[near(v)])) for i, v in kept]
    part = collections.Counter()
    for _, j, d in told:
        part[j] += d
    return collections.Counter((hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest(), j, part[j], d, sum(part.values()), i) for i, j, d in told)


def vectors():
    rng = random.Random(9)
    rows = [(i, [rng.gauss((i % 5 - 2) * 0.3, 0.2) for _ in range(64)]) for i in range(120)]
    rows += [(i, [0.25] * 64) for i in range(200, 230)] + [(0, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (None, None)]
    rows += [(300, [0.1] * 63), (301, [0.1] * 65), (302, [None] + [0.1] * 63), (303, [math.nan] + [0.1] * 63), (304, [math.inf] + [0.1] * 63), (305, []), (306, [1e30] * 64), (307, [-3e4] + [0.5] * 63)]
    return rows


@pytest.mark.parametrize(("kind", "k"), [("double", 8), ("double", 3), ("double", 500)])
def test_clusters_match_brute_force(spark, kind, k):
    rows = vectors()
    table = spark.createDataFrame([(i, v, *SAME) for i, v in rows], f"vec_id long, embedding array<{kind}>, {CLASH}").repartition(4)
    found = centroids.cluster(table, k=k, rounds=4)
    assert sorted(found.columns) == ["centroid_sha256", "cluster", "cluster_inertia", "distance", "inertia", "vec_id"]
    assert rows_of(found) == lloyd(rows, k, 4)


def test_ties_go_to_the_lower_number_and_empty_clusters_stay(spark):
    rows = [(i, [0.5] * 64) for i in range(6)] + [(6, [1.5] * 64)]
    found = centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=4, rounds=3)
    assert rows_of(found) == lloyd(rows, 4, 3)


def test_clusters_of_no_vectors(spark):
    table = spark.createDataFrame([(1, [0.1]), (2, None)], "vec_id long, embedding array<float>")
    found = centroids.cluster(table)
    assert found.count() == 0 and len(found.columns) == 6


# --- 13


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def awkward_texts():
    rng = random.Random(1)
    words = ["the", "don't", "it's", "x's", "I'd", "1234", "½", "Ünïcode", "naïve", "数据", "слово", "#$%", "…", "é", "\x1c\x1d", "\xa0", " ", "😀", "<|endoftext|>", "<|endof", "text|>", "'", "'r", "'re", "\n", "\n\n", "   ", "\t", "\r\n", "\x85"]
    made = [None, "", " ", "  \n ", "<|endoftext|>", "a<|endoftext|>  <|endoftext|> b", "'s", "''s", " 's"]
    made += ["".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    made += ["y" * 9000 + " " + "z" * 40, " " * 5000 + "x" + "\n" * 3000, "<|endoftext|>" * 300, "é" * 4000, "数" * 700 + " a" * 900, ("ab " * 50 + "q" * 1500) * 6]
    return made


def test_quick_counts_are_those_of_the_library(library):
    """By pieces and whole; every start of a pre-token is one of the library's."""
    encoder = token_counts.Encoder(PATH)
    for text in [t or "" for t in awkward_texts()]:
        whole = library.encode(text, add_special_tokens=False)
        assert encoder.count(text) == len(whole.ids), repr(text[:80])
        at, before, n = encoder.starts(text)
        assert n == len(whole.ids)
        assert [(whole.offsets[b][0], b) for b in before.tolist()] == list(zip(at.tolist(), before.tolist()))
    assert sum(encoder.by_pieces(t or "") for t in awkward_texts()) > 5


@pytest.mark.parametrize(("huge", "core", "overlap"), [(1 << 16, 1 << 15, 256), (300, 200, 40), (64, 48, 8), (10, 7, 1)])
def test_token_counts_match_the_library(spark, library, huge, core, overlap):
    """Small chunks splice everywhere, at special strings, long words and between bytes of a character too."""
    texts = awkward_texts()
    rows = [(i if i % 7 else None, t, None, *SAME) for i, t in enumerate(texts)] + [(3, texts[20], "s", *SAME)] * 5
    table = spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASH}").repartition(4)
    found = token_counts.count_tokens(table, PATH, huge=huge, core=core, overlap=overlap)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = collections.Counter()
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[i, len((t or "").encode()), n, n > 1024] += 1
    assert rows_of(found) == want


def test_a_text_over_8_mb(spark, library):
    rng = random.Random(2)
    text = " ".join(rng.choice(["over", "the", "Läufer", "12", "don't", "b" * 700]) for _ in range(130_000))
    table = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string")
    n = len(library.encode(text, add_special_tokens=False).ids)
    assert len(text) > 8 << 20
    assert {(r.doc_id, r.n_tokens) for r in token_counts.count_tokens(table, PATH).collect()} == {(1, n), (2, n), (3, 1)}


def test_other_tokenizers_and_no_documents(spark, none):
    assert token_counts.count_tokens(none, PATH).count() == 0
    other = tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    text = "Some words, here's one " * 40
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    n = len(Tokenizer.from_file(other).encode(text, add_special_tokens=False).ids)
    assert token_counts.count_tokens(table, other, huge=50, core=40, overlap=10).first().n_tokens == n


# --- queries


@pytest.mark.parametrize("name", sorted(n for n in oracle_sql() if n.startswith("op")))
def test_query_matches_its_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    found = queries()[name](spark, sf)
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(found.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert rows_of(found) == collections.Counter(tuple(brief(r[k]) for k in order) for r in want.fetchall())
