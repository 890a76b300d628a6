"""The numbered operators against brute force, and on awkward tables.

The awkward table has null texts, ids, languages and sources, empty and blank texts, one long text, repeated rows, ties, and
extra columns with names that the operators use inside.
"""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import exact_dedup, language, lm, mixing, near_dedup, packing, pii, quality, sharding, tokens, toxicity
from waymark.llm.queries import oracle_sql, queries, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, part string, node long, n double, kept string, shard string, fp string, train string"
_RNG = np.random.default_rng(5)
_SYLLABLES = {"en": "the and ing er on ti was of".split(), "de": "der und sch ung ein keit zu ü".split(), "fr": "le que ment eau é oi tre de".split()}


def prose(lang, n):
    s = _SYLLABLES[lang]
    return " ".join("".join(_RNG.choice(s, _RNG.integers(1, 4))) for _ in range(n))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def texts():
    rows = []
    for i in range(90):
        lang = ("en", "de", "fr")[i % 3]
        text = prose(lang, int(_RNG.integers(60, 160)))
        if i % 9 == 0:
            text += " you utter blorgface " + prose(lang, 5)
        rows.append((i, text, lang, f"s{i % 4}"))
    for i in range(90, 110):  # near copies of one text, in one of a few words
        words = rows[3][1].split()
        words[int(_RNG.integers(0, len(words)))] = "changed"
        rows.append((i, " ".join(words), "en", "s0"))
    for i in range(110, 130):  # exact copies but for white space and case of nothing
        rows.append((i, rows[5][1].replace(" ", ("  ", "\n", "\t ")[i % 3], 3), "fr", "s0"))
    return rows


def awkward(texts):
    long = " ".join(r[1] for r in texts[:90:3]) * 8
    more = [(200, None, "en", "s1"), (201, "", "de", None), (202, " \t\n ", None, "s1"), (203, long, "en", "s0"), (204, "one", "en", "s0"), (205, "One two", "en", "s0"), (206, "one two", "en", "s0")]
    more += [(None, "no id at all here", "en", "s2"), (None, None, None, None), (207, "12 34 +-*", "en", "s2"), (7, texts[7][1], texts[7][2], texts[7][3]), (7, texts[7][1], texts[7][2], texts[7][3]), (208, "　x y İ ΟΔΟΣ 's l'été 数", "fr", "s1")]
    return [(*r, 1, 2, "p", 3, 4.0, "k", "s", "f", "t") for r in texts + more]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(awkward(texts), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def rows(texts):
    return [(r[0], r[1], r[2], r[3]) for r in awkward(texts)]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    data = [(i, int(i % 10 != 1), int(i % 9 == 0)) for i in range(90)] + [(None, 1, 1), (3, None, None), (4, 1, 0)]
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")


def key(found, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in found.collect())


# --- words


def test_words_and_hashes_are_those_of_the_pattern():
    data = ["a b", None, "", " x\x0by\x1cz ", "é\tü", "ab" * 40 + " " + "ab" * 40, "end"]
    w = tokens.words(pa.array(data), lower=False)
    found = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[s:e], w.end[s:e])] for s, e in zip(w.at[:-1], w.at[1:])]
    assert found == [WORD.findall(x or "") for x in data]
    by_word = {}
    for word, h in zip(sum(found, []), w.hashes()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


# --- 1


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_matches_brute_force(docs, rows, order):
    """Interpolated probabilities from counts of tuples, word by word."""
    found = lm.score(docs, order=order, block_bytes=20_000).collect()
    train = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0
    every = [(i, ["<s>"] * (order - 1) + [*WORD.findall(lower(t)), None]) for i, t, _, _ in rows]
    count, context = collections.Counter(), collections.Counter()
    for i, ws in every:
        if train(i):
            for k in range(order):
                for p in range(order - 1, len(ws)):
                    count[tuple(ws[p - k : p + 1])] += 1
                    context[tuple(ws[p - k : p])] += 1
    one = collections.Counter({g[0]: n for g, n in count.items() if len(g) == 1})
    n, v = sum(one.values()), len(one)
    want = collections.Counter()
    for i, ws in every:
        base = score = 0.0
        for p in range(order - 1, len(ws)):
            prob = (one[ws[p]] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(prob)
            for k in range(1, order):
                h = tuple(ws[p - k : p])
                share = 8 / (context[h] ** 0.3 + 8) if context[h] else 1.0
                prob = (1 - share) * (count[(*h, ws[p])] / context[h] if context[h] else 0) + share * prob
            score += math.log10(prob)
        ws = ws[order - 1 :]
        want[i, not train(i), len(ws), sum(one[w] > 0 for w in ws), n, round(base, 4), round(score, 4)] += 1
    got = collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in found)
    assert got == want, sorted(map(str, (got - want)))[:5] + sorted(map(str, (want - got)))[:5]


def _model(texts, train, order):
    grams = lm.Grams(pa.array(texts), np.array(train), order)
    v = int((grams.counts[0][np.arange(len(grams.counts[0])) != grams.pads[0]] > 0).sum())
    n = int(grams.n_tokens[np.array(train)].sum())
    return grams, lm.Automaton(grams, grams.counts, n, v)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_lm_states_sum_to_one(order):
    """From every state, the automaton's own steps over all known words, the end and one unknown word sum to 1."""
    base = ["a b a c a b d", "b a c", "d d a b a"]
    grams, found = _model([*base, "a b c d unknown"], [True] * 3 + [False], order)
    labels = np.unique(grams.where[0])
    # nothing follows the end, so its states are never left
    totals = np.concatenate([[1], *(np.where(np.isin(at, grams.at[1:] - 1) & (np.arange(len(at)) != pad), 0, n) for at, pad, n in zip(grams.token_of[:-1], grams.pads, grams.counts))])
    for state in np.flatnonzero(totals > 0):
        _, weight = found.step(np.full(len(labels), state), labels)
        assert (10**weight).sum() == pytest.approx(1.0), state
    assert set(found.fail[totals > 0]) <= set(np.flatnonzero(totals > 0))  # a failure arc leads to a state that was seen


def test_lm_segments_are_read_alike():
    texts = [prose("en", n) for n in (1, 5, 300, 77)] + [""]
    grams, found = _model(texts, [True, False, True, True, False], 3)
    whole = found.read(grams, 3, 10_000)
    for segment in (2, 3, 16, 301):
        assert np.allclose(found.read(grams, 3, segment), whole)
    state = np.array([found.start])
    for token in range(grams.at[2], grams.at[3]):  # one text, one word after the other
        state, weight = found.step(state, grams.where[0][token : token + 1])
        assert weight[0] == pytest.approx(whole[token])


# --- 2


def test_toxicity_learns_the_word(docs, labels):
    found = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [i for i in range(90) if found[i].held_out]
    assert len(held) > 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())
    assert np.mean([found[i].predicted == int(i % 9 == 0) for i in held]) > 0.95
    assert toxicity.score(docs, labels).count() == docs.count()


def test_toxicity_with_wrong_labels(spark):
    """Held-out rows only, a twentieth of the labels flipped, most rows without a label, ids below zero."""
    rng = np.random.default_rng(8)
    insults = ["blorgface", "snarkwit", "grumblor", "vexnod", "drabclot"]
    toxic = {-i: bool(rng.random() < 0.3) for i in range(900)}
    rows = [(i, prose("en", 50) + (" you " + " ".join(rng.choice(insults, 2)) + " " if y else " ") + prose("en", 10)) for i, y in toxic.items()]
    flipped = [(i, int(y != (rng.random() < 1 / 20))) for i, y in toxic.items() if i % 2 == 0]
    found = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()}
    held = [i for i in toxic if found[i].held_out]
    assert len(held) > 100 and np.mean([found[i].predicted == toxic[i] for i in held]) > 0.95


def test_toxicity_without_labels(docs, labels):
    assert {r.score for r in toxicity.score(docs, labels.where("false")).collect()} == {0.0}


def test_label_model_outvotes_a_poor_voter():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    good = np.stack([rng.random(2000) < np.where(y, 0.6, 0.03) for _ in range(10)], 1)
    good = np.concatenate([good, ~good.any(1, keepdims=True)], 1)
    poor = rng.random((2000, 2)) < 0.5
    labels = np.where(rng.random(2000) < 0.85, y, ~y).astype(int)  # a tenth and more of the labels are wrong
    right = (labels == y).mean()
    labels[1000:] = -1
    posterior, rates, _, trust = toxicity.label_model(np.concatenate([good, poor], 1).astype(float), labels)
    assert ((posterior > 0.5) == y).mean() > right + 0.05 and abs(trust - right) < 0.05
    assert (rates[1, :10] > 0.5).all() and (rates[0, :10] < 0.1).all() and (np.abs(rates[1, 11:] - rates[0, 11:]) < 0.1).all()


# --- 3


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    ids = {}
    for i, t, _, _ in rows:
        ids.setdefault(i, []).append([*whole.encode(t or "", add_special_tokens=False).ids, 1])
    found = packing.pack(docs, tokenizer_path()).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()] and sum(r.length for r in parts) <= 2048
    for i, texts in ids.items():
        want = collections.Counter(len(x) for x in texts)
        assert sum(r.length for r in by_doc[i]) == sum(n * k for n, k in want.items())
        for r in by_doc[i]:
            assert any(len(x) == r.doc_tokens and zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in texts)
        if len(texts) == 1:
            parts = sorted(by_doc[i], key=lambda r: r.start)
            assert [r.start for r in parts] == [0, *np.cumsum([r.length for r in parts])[:-1].tolist()]


def test_cutting_stock_finds_the_known_optimum():
    """Lengths 3, 4, 5 from 12: 4+4+4, 3+4+5 ... pack without waste."""
    sizes, demand = np.array([3, 4, 5]), np.array([40.0, 60.0, 20.0])
    found = packing.cutting_stock(sizes, demand, 12)
    assert sum(t for _, t in found) == pytest.approx(sizes @ demand / 12, rel=0.01)
    assert np.allclose(sum(c * t for c, t in found), demand)


@pytest.mark.parametrize("text", ["it's I'LL don't ,'t ''s", "À É × ÷ ª µ ß ÿ", "a¹ ½ x_y --- …", "<|endoftext|> x", "İ ΟΔΟΣ ́b", "123abc4 a-b.c", "\x00\x01 a\x7fb", "'S 'RE l'été", "١٢ 数字"])
def test_word_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.loaded(tokenizer_path())(pa.array([text, None]))[0].tolist() == [*want, 1]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    """A tokenizer that splits otherwise is not taken apart into pieces."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(tokenizer_path()).to_str())
    assert packing.loaded(tokenizer_path()).by_pieces
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]  # no lower case
    path = str(tmp_path / "other.json")
    Tokenizer.from_str(json.dumps(spec)).save(path)
    text = "It's A Test of 12 É words"
    assert packing.WordIds(path)(pa.array([text, None]))[0].tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]


# --- 4


def test_shards_are_balanced_and_gapless(docs, rows):
    found = sharding.shard(docs.where("doc_id <> 203 or doc_id is null"), 4).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r.shard].append(r)
    loads = [sum(r.size for r in x) for x in by.values()]
    assert set(by) == set(range(4)) and max(loads) - min(loads) < 0.1 * sum(loads) / 4 + 2 * max(r.size for r in found)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows if i != 203)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in found) == want


def test_shards_are_those_of_the_ring(docs, rows):
    """Documents in the order of their places, byte by byte into the next shard clockwise that has room."""
    shards, slack = 3, 0.01
    spots = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("place")).collect()
    every = collections.defaultdict(list)
    for r in spots:
        size = len((r.text or "").encode()) + 8
        every[r.place % sharding.SEGMENTS].append((r.place, (r.doc_id is not None, r.doc_id or 0), size, zlib.crc32((r.text or "").encode()), r.doc_id))
    nodes = sorted(sharding.ring(shards))
    room = [-(-int(sum(x[2] for rs in every.values() for x in rs) * (1 + slack)) // shards) + 1] * shards
    want = collections.Counter()
    for segment in sorted(every):
        clockwise = [s for at, s in nodes if at >= segment] + [s for at, s in nodes if at < segment]
        fill, owner = [], {}
        total = sum(x[2] for x in every[segment])
        for s in clockwise:
            part = min(room[s], total - len(fill))
            room[s] -= part
            fill += [s] * part
            if len(fill) == total:
                break
        before = 0
        for place, _, size, crc, i in sorted(every[segment], key=lambda x: (x[0], x[1], x[2], x[3])):
            want[i, size, crc, fill[before + size // 2]] += 1
            before += size
    assert key(sharding.shard(docs, shards, slack=slack), "doc_id", "size", "text_crc32", "shard") == want


def test_one_more_shard_or_document_moves_little():
    """At the slack that the query uses: what moves is what the new shard takes and little besides."""
    rng = np.random.default_rng(3)
    loads = {k: int(n) for k, n in enumerate(rng.integers(900, 1100, sharding.SEGMENTS))}
    more = {k: n + (10 if k % 100 == 0 else 0) for k, n in loads.items()}

    def owners(sizes, shards):
        out = {}
        for s, a, b, shard in sharding.bounded(sizes, shards, sharding.ring(shards)):
            out.setdefault(s, collections.Counter())[shard] += b - a
        return out

    def moved(x, y):
        return sum(sum((x[s] - y[s]).values()) for s in x) / sum(loads.values())

    now = owners(loads, 24)
    assert moved(now, owners(more, 24)) < 0.05 and moved(now, owners(loads, 25)) < 0.35


def test_overflow_moves_little():
    """Bounded loads move only what a full shard cannot take."""
    rng = np.random.default_rng(0)
    loads = {k: int(n) for k, n in enumerate(rng.integers(900, 1100, 4096))}
    nodes = sharding.ring(8, 128, 4096)
    ranges = sharding.bounded(loads, 8, nodes, 0.01)
    totals = collections.Counter()
    for s, a, b, shard in ranges:
        totals[shard] += b - a
    assert sum(totals.values()) == sum(loads.values()) and max(totals.values()) <= 1.01 * sum(loads.values()) / 8 + 2
    place = [n[0] for n in nodes]
    home = {s: nodes[np.searchsorted(place, s) % len(nodes)][1] for s in loads}
    assert sum(b - a for s, a, b, shard in ranges if shard != home[s]) < 0.35 * sum(loads.values())


# --- 5


def test_language_held_out(docs, texts):
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    held = [r for r in texts if r[0] < 90 and found[r[0]].held_out]
    assert len(held) > 10 and np.mean([found[r[0]].lang_pred == r[2] for r in held]) > 0.9
    assert all(found[i].lang_pred == "und" for i in (200, 201, 202, 207)) and all(0 <= r.score <= 1 for r in found.values())
    assert language.identify(docs).count() == docs.count()


def test_language_learns_rare_and_long_languages(spark):
    rows = [(i, prose("en", 40), "en") for i in range(300)] + [(1000 + i, prose("de", 40), "de") for i in range(8)] + [(2000 + i, prose("fr", 5000), "fr") for i in range(8)]
    assert min(len(t.encode()) for _, t, x in rows if x == "fr") > language.LONGEST
    found = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=6).collect()}
    for lang in ("en", "de", "fr"):
        assert np.mean([found[i] == lang for i, _, x in rows if x == lang]) > 0.9


def test_language_without_labels(docs):
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_switches_within_a_text():
    model = language.train([prose("en", 200), prose("de", 200), prose("fr", 200)] * 4, ["en", "de", "fr"] * 4)
    c = language.chains(pa.array([prose("en", 30) + " " + prose("de", 30)]))
    marginal, _, _ = language.forward_backward(c, language.emissions(c, model.weights), model.moves, model.first)
    best = [model.langs[k] for k in marginal.argmax(1)]
    assert np.mean([b == "en" for b in best[:30]]) > 0.8 and np.mean([b == "de" for b in best[30:]]) > 0.8


def test_forward_backward_is_exact():
    """Against the sum over all label sequences of short chains."""
    import itertools

    rng = np.random.default_rng(2)
    c = language.chains(pa.array(["a b c", "d", "", "b b"]))
    emit, moves, first = rng.normal(size=(len(c.letters), 3)).astype(np.float32), rng.normal(size=(3, 3)), rng.normal(size=3)
    marginal, expected, log_z = language.forward_backward(c, emit, moves, first)
    want, pairs, z = np.zeros((len(c.word), 3)), np.zeros((3, 3)), 0.0
    for a, b in zip(c.at[:-1], c.at[1:]):
        if a == b:
            continue
        total, m, p = 0.0, np.zeros((b - a, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=b - a):
            s = first[path[0]] + sum(emit[c.word[a + t], y] for t, y in enumerate(path)) + sum(moves[x, y] for x, y in itertools.pairwise(path))
            w = math.exp(s)
            total += w
            for t, y in enumerate(path):
                m[t, y] += w
            for x, y in itertools.pairwise(path):
                p[x, y] += w
        want[a:b], pairs, z = m / total, pairs + p / total, z + math.log(total)
    assert np.allclose(marginal, want, atol=1e-5) and np.allclose(expected, pairs, atol=1e-4) and log_z == pytest.approx(z, abs=1e-4)


def test_segments_carry_their_messages():
    """A long chain in segments has the distributions of the whole chain, whatever is beside it."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abcdef"), n)) for n in (97, 3, 40, 1, 64)] + [""]
    c = language.chains(pa.array(texts))
    emit, moves, first = rng.normal(size=(len(c.letters), 3)).astype(np.float32), rng.normal(size=(3, 3)), rng.normal(size=3)
    whole = language.forward_backward(c, emit, moves, first)[0]
    for segment in (1, 2, 16, 40, 97):
        assert np.allclose(language.forward_backward(c, emit, moves, first, segment)[0], whole, atol=1e-5)


def test_only_letters_make_a_language(spark):
    model = language.train([prose("en", 200), prose("de", 200)] * 4, ["en", "de"] * 4)
    langs, score = language.predict(pa.array(["\u00b2 \u00bd \u2167 \u2460 12_3", None, "", "the", "\u6587"]), model)
    assert langs[:3] == ["und"] * 3 and "und" not in langs[3:] and list(score[:3]) == [0, 0, 0]
    alone = language.predict(pa.array(["the ing of was"]), model)[1][0]
    assert language.predict(pa.array([prose("de", 50), "the ing of was", "x"]), model)[1][1] == pytest.approx(alone, abs=1e-6)


# --- 6


def test_mix_reaches_its_targets(docs, rows):
    found = mixing.mix(docs, block=4).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, target, free = {s: k % 3 + 1 for k, s in enumerate(names)}, {}, set(names)
    left = sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    by_id = {i: s for i, _, _, s in rows if i is not None}
    taken = collections.Counter()
    for r in found:
        s = by_id.get(r.doc_id)
        if r.doc_id is not None:
            assert r.source_size == sizes[s] and r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size] += r.taken
    for s in names:
        if sizes[s]:
            assert abs(taken[sizes[s]] - target[s]) <= 16 + 0.02 * target[s]
    assert collections.Counter((r.doc_id, r.size) for r in found) == collections.Counter((i, len(WORD.findall(t or ""))) for i, t, _, _ in rows)
    assert key(mixing.mix(docs.repartition(2), block=4), "doc_id", "size", "taken") == collections.Counter((r.doc_id, r.size, r.taken) for r in found)


def scrambled(x, key):
    h = (x % mixing.P * 48271 + x // mixing.P * 69621 + key * 40692 + 1) % mixing.P
    h = h * (h + 16807) % mixing.P
    return h * (h + 271828183) % mixing.P


def test_shard_counts_are_the_draws(docs, rows):
    """Each shard's slots, drawn one by one, and each source's counts scaled to its number of slots."""
    block, shard_slots = 4, 64
    slots = {(r.source, r.i): r.shard for r in mixing.dealt(docs, block=block, shard_slots=shard_slots).collect()}
    names, total = sorted({s for _, _, _, s in rows if s is not None}) + [None], collections.Counter()
    for _, t, _, s in rows:
        total[s] += len(WORD.findall(t or ""))
    targets = {r.source_size: r.target for r in mixing.mix(docs, block=block).collect()}
    m = {}
    for s in names:
        if total[s]:
            n = -(-total[s] // block)
            whole = math.floor(targets[total[s]] * n / total[s] + 1e-9)
            m[s] = whole + (math.floor((targets[total[s]] * n / total[s] - whole) * total[s] / n + 0.5) > 0)
    every = sum(m.values())
    bounds = np.cumsum([m.get(s, 0) for s in names]) * (mixing.P / every)
    drawn = collections.Counter()
    for d in range(every):
        drawn[names[int(np.searchsorted(np.floor(bounds), scrambled(d, 11), "right"))], d // shard_slots] += 1
    want = collections.Counter()
    for s in names:
        own = sorted((k, n) for (x, k), n in drawn.items() if x == s)
        reach = np.floor(np.cumsum([0, *(n for _, n in own)]) * (m.get(s, 0) / max(1, sum(n for _, n in own))) + 1e-9).astype(int)
        for (k, _), n in zip(own, np.diff(reach), strict=True):
            want[s, k] += int(n)
    got = collections.Counter((s, k) for (s, _), k in slots.items())
    assert got == +want and sum(got.values()) == every and max(slots.values()) > 20
    free = chi = 0
    for s, n in m.items():  # neither a lattice nor clustered
        if n > 5 * every / shard_slots:
            chi += sum((drawn[s, k] - n * shard_slots / every) ** 2 / (n * shard_slots / every) for k in range(every // shard_slots))
            free += every // shard_slots * (1 - n / every)
    assert free and abs(chi - free) < 5 * math.sqrt(2 * free)
    other = {(r.source, r.i): r.shard for r in mixing.dealt(docs, block=block, shard_slots=shard_slots, seed=1).select("source", "i", "shard").distinct().collect()}
    assert other.keys() == slots.keys() and np.mean([other[k] == slots[k] for k in slots]) < 0.9


def test_small_sources_get_their_words(spark):
    rows = [(i, prose("en", 300), "big") for i in range(20)] + [(100, "a b c d e", "small"), (101, "x " * 40, "tiny"), (102, None, "void")]
    found = {r.doc_id: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert found[100].target == found[100].taken == 15 and found[101].target == 120 and abs(found[101].taken - 120) <= 8 and found[102].taken == 0
    assert abs(sum(found[i].taken for i in range(20)) - found[0].target) <= 32


@pytest.mark.parametrize("n", [1, 2, 7, 104729, 104723 * 2])
def test_permutations_are_bijections(spark, n):
    lit = F.lit(n).cast("long")
    p = spark.range(n).select("id", mixing.permuted(F.col("id"), lit, mixing.mirrors(F.lit(3).cast("long"), lit)).alias("p")).toPandas().sort_values("id").p.to_numpy()
    assert np.array_equal(np.sort(p), np.arange(n))
    if n > 100:  # steps between neighbours are many, and nothing keeps its order
        assert len(np.unique(np.diff(p))) > n / 20 and abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.02


def test_mixed_texts_hold_the_words_taken(docs):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, block=4).where("doc_id < 100").groupBy("doc_id").agg(F.sum("taken").alias("taken")).collect()}
    found = collections.Counter()
    for r in mixing.mixed_texts(docs, block=4).where("doc_id < 100").collect():
        found[r.doc_id] += len(WORD.findall(r.text))
    assert found == {i: n for i, n in taken.items() if n}
    clash = docs.withColumns({c: F.lit(c) for c in ("parts", "whole", "turn", "mix_row", "doc", "rank", "skey", "times")})
    assert mixing.mixed_texts(clash, block=4).columns == clash.columns and key(mixing.mixed_texts(clash, block=4), "doc_id", "text", "turn") == collections.Counter({(*k, "turn"): n for k, n in key(mixing.mixed_texts(docs, block=4), "doc_id", "text").items()})


# --- 7


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    times = collections.Counter(zip(words, words[1:], words[2:]))
    marked = set()
    for i in range(len(words) - 2):
        if times[tuple(words[i : i + 3])] > 1:
            marked |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_quality_rules_match_brute_force(spark, labels, rows):
    extra = [(300, "a b c a b c d\nx\n\nx\n x\n| # é", "en", "s"), (301, "w " * 200, "en", "s"), (302, "one\ntwo\none\none", "en", "s")]
    df = spark.createDataFrame([r[:4] for r in rows] + extra, "doc_id long, text string, lang string, source string")
    found = quality.judged(df, labels)
    want = collections.Counter((i, *brute_rules(t)) for i, t, _, _ in rows + extra)
    assert key(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in found.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_quality_drops_what_differs_from_the_trusted(spark):
    clean = [(i, prose("en", 80)) for i in range(60)]
    junk = [(i, " ".join(w + "%%%" for w in prose("en", 80).split())) for i in range(60, 84)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(i, 0) for i in range(60, 76)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.judged(df, labels).where("kept").collect()}
    assert len(kept & set(range(60))) >= 58 and not kept & set(range(60, 84))
    assert kept == {r.doc_id for r in quality.kept(df, labels).collect()}
    for none in (labels.where("false"), labels.where("quality = 1")):
        assert quality.judged(df, none).where("kept").count() == 84


def test_quality_scores_and_threshold_match_brute_force(spark):
    clean = [(i, prose("en", 80)) for i in range(120)]
    junk = [(i, " ".join(w + "%%" if i % 3 else w for w in prose("en", 80).split())) for i in range(120, 180)]
    rows = clean + junk + [(200, None), (-5, prose("de", 60))]
    marks = {i: int(i < 100) for i in range(0, 180, 2)} | {-5: 0}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks.items(), (None, 1), (4, None)], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.judged(df, labels).collect()}
    half = lambda i: zlib.crc32(str(i).encode()) % 2
    grams = lambda t: [((d[k] << 16 | d[k + 1] << 8 | d[k + 2]) * 2654435761 % 2**32) >> 17 for d in [(t or "").encode()] for k in range(len(d) - 2)]
    raw, target = np.ones(1 << 15), np.ones(1 << 15)
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += marks.get(i) == 1 and half(i) == 0
    ratio = np.round((np.log(target / target.sum()) - np.log(raw / raw.sum())) * 2**20).astype(int)
    for i, t in rows:
        g = grams(t)
        assert found[i].score == pytest.approx(sum(ratio[k] for k in g) / (max(len(g), 1) * 2**20), abs=1e-12)
    held = [(found[i].score, q) for i, q in marks.items() if half(i) == 1 and not found[i].base_failed]
    good, bad = sum(q for _, q in held), sum(1 - q for _, q in held)
    cost = lambda t: 20 * sum(q and s < t for s, q in held) / good + sum((not q) and s >= t for s, q in held) / bad
    passing = [r for r in found.values() if not r.base_failed]
    cut = (min(r.score for r in passing if r.kept) + max(r.score for r in passing if not r.kept)) / 2
    assert all(r.kept == (r.score >= cut) for r in passing) and good and bad
    assert cost(cut) <= min(cost(s) for s, _ in held) + 1e-9
    one = quality.rules(pa.array([rows[0][1]]), ratio)[5][0]  # a score is the same in any batch
    assert quality.rules(pa.array([t for _, t in rows[::-1]]), ratio)[5][-1] == one == found[0].score


# --- 8


def plain_base(text):
    """The contract's patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


PII = ["mail a.b+c@x-y.example.com_d@e.fr, z@q", "10.0.0.256 1.2.3.4.5.6.7.8 001.02.003.4", "4539 1488 0343 6467 and 4539148803436468", "+1 (555) 010-9999. +44 20 7946 0958 12345 678", "a@b.c@d.e é ñ 8.8.8.8", "", "12.34.56", "x@y.z+1 2 3 4 5 6 7 8", "1.2.3.4-5 6 @@@ a@-.-"]


def test_base_spans_are_the_patterns(texts):
    rng = np.random.default_rng(3)
    made = ["".join(rng.choice(list("a1.@+- _9é%(4"), 60)) for _ in range(3000)]
    for text in PII + made:
        assert pii.base_spans(text) == plain_base(text), text


def test_base_spans_are_linear():
    import time

    start = time.time()
    for text in ("555-123-4567 " * 20_000, "a" * 300_000 + " x@y.zz", "1" * 300_000 + ". +1" + " " * 200_000, "1." * 200_000, "+1" * 100_000, "a.b" * 100_000 + "@"):
        pii.accepted(text, pii.base_spans(text), np.ones(2 * pii.LABELERS + len(pii.KINDS) + 6 + pii.CONTEXT + 1))
        assert [s for s in pii.free([("id", a, a + 3) for a in range(0, 60, 2)], [(5, 9), (20, 21)])] == [("id", a, a + 3) for a in range(0, 60, 2) if not (a < 9 and 5 < a + 3) and not (a < 21 and 20 < a + 3)]
    assert time.time() - start < 20


def test_pii_adds_spans_and_keeps_base_ones(spark):
    rows = [(i, t) for i, t in enumerate(PII * 6)] + [(100, 'set token = "9885103314b39ed955fd8ac9efa74c6fd87b66ee" now'), (101, "password=changeme"), (102, None), (103, prose("en", 50)), (104, "write to jo.doe (at) mail.example.com soon"), (None, "a@b.cc")]
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        base = plain_base(text or "")
        r = found[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in pii.KINDS[:4]]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert found[100].spans == "secret:13:53" and found[103].spans == found[101].spans == found[102].spans == ""


def test_long_secrets_and_addresses_are_whole(spark):
    import time

    token = hashlib.sha256(b"a").hexdigest() * 12
    address = "j" * 70 + " (at) " + "mail" * 8 + ".b1.c2.d3.e4.example.com"
    rows = [(i, t) for i, t in enumerate(PII * 6)] + [(100, f'set token = "{token}" now'), (101, f"write to {address} soon")]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[100] == f"secret:13:{13 + len(token)}" and found[101] == f"email:9:{9 + len(address)}"
    start = time.time()
    for text in ("token=" * 100_000, "token=" + "a" * 500_000, "a" * 500_000 + " (at) b", "a (at) " + "bb." * 200_000, "a(at)" * 100_000):
        pii.loose_spans(text)
    assert time.time() - start < 10


# --- 9


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_match_brute_force(docs, rows):
    groups = collections.defaultdict(list)
    for i, t, _, _ in rows:
        groups[normal(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = collections.Counter((i, keep[normal(t)], len(groups[normal(t)]), i == keep[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t, _, _ in rows)
    assert key(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_fingerprints_compose():
    body = bytes(_RNG.integers(0, 256, 5000, np.uint8))
    whole = exact_dedup.fingerprint([body])
    for size in (1, 7, 999, 5000):
        assert exact_dedup.fingerprint(exact_dedup.chunks(body, size)) == whole
    a, b, c = (exact_dedup.fingerprint([body[x:y]]) for x, y in ((0, 10), (10, 3000), (3000, 5000)))
    assert exact_dedup.combine(a, exact_dedup.combine(b, c)) == exact_dedup.combine(exact_dedup.combine(a, b), c) == whole


def test_chunks_of_huge_texts_are_hashed_apart(spark, monkeypatch):
    """Chunks cut anywhere, also within runs of white space, combine to the fingerprint of the whole text."""
    rng = np.random.default_rng(4)
    made = ["".join(rng.choice(list("ab \t\n\u00e9"), int(rng.integers(60, 400)))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate([*made, *(t.replace(" ", " \t") for t in made), " " * 300, "\n", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = key(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size", "text_sha256")
    for body in made:
        data, body_parts = body.encode(), []
        for k in range(0, len(data), 7):
            body_parts.append(exact_dedup.normalised_chunk(data[k : k + 7], data[k - 1] if k else None))
        assert b"".join(body_parts) == exact_dedup.normalised(body)
    monkeypatch.setattr(exact_dedup, "HUGE", 50)
    monkeypatch.setattr(exact_dedup, "CHUNK", 16)
    assert key(exact_dedup.exact_groups(df), "doc_id", "keep_id", "group_size", "text_sha256") == plain
    assert sum(n for (_, _, size, _), n in plain.items() if size > 1) > 80


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PRIME", 3)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(exact_dedup)
    try:
        rows = [(k, "abc"[k % 3] * 5 + "x" * (k % 2)) for k in range(12)]
        found = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(exact_dedup)
    assert found == {k: k % 6 for k in range(12)}


# --- 10


def brute_components(rows, n, similar=80):
    sets = []
    for _, t, _, _ in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= similar * (len(sets[a]) + len(sets[b]) - i):
                parent[find(a)] = find(b)
    low = {}
    for k, r in enumerate(rows):
        low[find(k)] = min((x for x in (low.get(find(k)), r[0]) if x is not None), default=None)
    return collections.Counter((r[0], len(sets[k]), low[find(k)], r[0] == low[find(k)]) for k, r in enumerate(rows))


@pytest.mark.parametrize("n", [4, 5])
def test_near_groups_match_brute_force(docs, rows, n):
    assert key(near_dedup.near_groups(docs, shingle=n), "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows, n)


def test_ids_that_repeat_with_other_texts(spark):
    a, b, c = (prose("en", 60) for _ in range(3))
    rows = [(1, a, 0, 0), (1, b, 0, 0), (1, c, 0, 0), (2, b + " more", 0, 0), (0, c + " more", 0, 0), (None, a + " more", 0, 0), (None, "x y", 0, 0)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert key(near_dedup.near_groups(df, shingle=4), "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows, 4)


def test_near_groups_of_random_edits(spark):
    """Chains and stars of edits around the threshold, and many texts with one passage in common."""
    rng = np.random.default_rng(9)
    rows, passage = [], prose("en", 25)
    for g in range(12):
        text = prose("de", 70).split()
        for _ in range(14):
            copy = list(text)
            for _ in range(int(rng.integers(0, 5))):
                copy[int(rng.integers(0, len(copy)))] = f"w{rng.integers(1e6)}"
            rows.append((len(rows), " ".join(copy), None, None))
            if rng.random() < 0.3:
                text = copy
    rows += [(len(rows) + k, passage + " " + prose("fr", int(rng.integers(10, 40))), None, None) for k in range(60)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    assert key(near_dedup.near_groups(df, shingle=4), "doc_id", "n_shingles", "component_id", "kept") == brute_components(rows, 4)


# --- all


def test_empty_tables(none, labels):
    for found in (lm.score(none), toxicity.score(none, labels), packing.pack(none, tokenizer_path()), sharding.shard(none), language.identify(none), mixing.mix(none), quality.judged(none, labels), pii.find(none), exact_dedup.exact_groups(none), near_dedup.near_groups(none)):
        assert found.count() == 0


def test_queries_are_registered():
    names = list(queries())
    assert [next(n for n in names if n.startswith(f"op{k}_")) for k in range(1, 11)] and "pipeline" in names and set(oracle_sql()) <= set(names)


def test_pipeline_rows_follow_their_own_verdicts(spark, labels, tmp_path):
    """Ids that repeat with other texts, rows without an id, and columns with names that stages use inside."""
    import corpus_pipeline

    text = {k: prose("en", 70) for k in "abcd"}
    near = " ".join(text["a"].split()[:-1] + ["other"])
    short = "too short"
    data = [(1, text["a"]), (1, text["b"]), (1, text["b"]), (2, text["a"].replace(" ", "  ")), (None, text["c"]), (None, text["c"]), (None, text["d"]), (3, text["c"]), (None, short), (5, short), (5, near), (6, None), (None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, parts string, turn string, kept_id string, row_key string, kept string, component string, good string, own string"
    docs = spark.createDataFrame([(i, t, "en", "s", None, *(["x"] * 8)) for i, t in data], schema).repartition(3)
    labels.where("false").write.parquet(str(tmp_path / "labels.parquet"))  # base rules alone decide
    pairs = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    every = collections.Counter(data)
    first = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert first.columns == docs.columns and pairs(first) == collections.Counter({k: n for k, n in every.items() if k[1] and len(k[1].split()) >= 50})
    exact = corpus_pipeline.exact_stage(spark, docs, str(tmp_path))
    assert exact.columns == docs.columns
    assert pairs(exact) == collections.Counter([(1, text["a"]), (1, text["b"]), (None, text["d"]), (3, text["c"]), (5, short), (5, near), (6, None)])
    close = corpus_pipeline.near_stage(spark, docs, str(tmp_path))
    assert close.columns == docs.columns
    got = pairs(close)
    assert got[1, text["a"]] == 1 and got[1, text["b"]] == 1 and got[3, text["c"]] == 1 and got[None, text["d"]] == 1 and got[5, near] == 0 and got[None, text["c"]] == 0
    assert got[6, None] == 1 and got[None, None] == 1 and got[5, short] == 1 and sum(got.values()) == 7
    mixed = corpus_pipeline.mixing_stage(spark, docs.withColumn("source", F.coalesce("source", "lang")), str(tmp_path))
    assert mixed.columns == docs.columns
    words = lambda c: sum(n * len(WORD.findall(t or "")) for (_, t), n in c.items())
    assert words(pairs(mixed)) == words(every)  # one source: all of its words


def test_pipeline_on_an_empty_table(spark, none, labels, tmp_path):
    import corpus_pipeline

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, now, str(tmp_path)).count() == 0


def test_a_very_long_text(spark):
    """One text of over 8 MB beside short ones, through the operators that read texts in batches."""
    long = " ".join(f"w{i % 5000} x{i % 77}" for i in range(900_000))
    assert len(long) > 8 << 20
    df = spark.createDataFrame([(0, long), (1, prose("en", 60)), (2, long + " "), (3, None)], "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s")).repartition(2)
    exact = {r.doc_id: r for r in exact_dedup.exact_groups(df).collect()}
    assert exact[0].text_sha256 == hashlib.sha256(long.encode()).hexdigest() and exact[0].group_size == 1
    assert {r.doc_id: r.component_id for r in near_dedup.near_groups(df, shingle=4).collect()} == {0: 0, 1: 1, 2: 0, 3: 3}
    assert {r.doc_id: r.n_tokens for r in lm.score(df).collect()} == {0: 1_800_001, 1: 61, 2: 1_800_001, 3: 1}
    assert {r.doc_id: r.lang_pred for r in language.identify(df).collect()} == {0: "en", 1: "en", 2: "en", 3: "und"}


def test_pipeline_stages_on_awkward_rows(spark, docs, labels, tmp_path):
    import corpus_pipeline

    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    own.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        counts.append(now.count())
        if k < 4:
            assert now.columns == own.columns
        if k == 1:
            assert now.select(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")).distinct().count() == counts[1]
    assert counts[0] < own.count() and counts[1] < counts[0] and counts[2] < counts[1] and counts[4] > 0


def test_segments_of_all_long_texts_run_in_step(monkeypatch):
    model = language.train(["the cat sat on the mat", "der hund lag auf dem sofa"], ["en", "de"], rounds=2)
    texts = [" ".join(["the cat", "der hund auf"][k % 2] for k in range(n)) for n in (40, 3, 90, 61)]
    monkeypatch.setattr(language, "SEGMENT", 16)
    calls, transfers = [], language.transfers
    monkeypatch.setattr(language, "transfers", lambda *a: calls.append(1) or transfers(*a))
    langs, score = language.predict(pa.array(texts), model)
    assert len(calls) == 1
    for text, lang, s in zip(texts, langs, score, strict=True):
        one, own = language.predict(pa.array([text]), model)
        assert one == [lang] and own[0] == pytest.approx(s, abs=1e-6)
