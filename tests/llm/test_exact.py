"""Operators with exact answers, against brute force, libraries and SQL."""
import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import brown, common, mixing, orderhash, pieces, pii, rules, simhash, urls
from tidewheel.llm import queries as q
from tidewheel.llm.components import components


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def against_sql(df, sql, folder):
    con = duckdb.connect()
    for name in common.SCHEMAS:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert Counter(found.fetchall()) == Counter(tuple(r[n] for n in names) for r in df.collect())
    assert sorted(names) == sorted(df.columns)


@pytest.mark.parametrize("name", ["op2_url_filter", "op10_mixing"])
def test_queries_equal_their_sql(spark, middle, name):
    against_sql(q.QUERIES[name](spark, middle), q.ORACLES[name], middle)


def test_pieces_equal_the_library(spark, small, texts, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer())
    got = {r.doc_id: r for r in q.QUERIES["op4_sentencepiece"](spark, small).collect()}
    for key, text in texts:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    for r in pieces.decode(pieces.encode(odd, q.tokenizer()), q.tokenizer()).collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.decoded == library.decode(ids)


def test_pieces_in_one_pass_equal_the_two_steps(odd):
    model = q.tokenizer()
    rows = odd.withColumn("IDS", F.lit("old")).withColumn("decoded", F.lit(3))
    want = pieces.decode(pieces.encode(odd, model), model)
    got = pieces.round_trip(rows, model)
    assert got.columns == want.columns
    assert Counter(map(str, rows_of(got))) == Counter(map(str, rows_of(want)))
    assert pieces.round_trip(odd.where("false"), model).count() == 0


def test_a_pair_of_pieces_is_judged_once(texts, monkeypatch):
    asked, judge = [], pieces.PieceTable.compatible
    monkeypatch.setattr(pieces.PieceTable, "compatible", lambda self, a, b: asked.append((a, b)) or judge(self, a, b))
    encoder = pieces.PieceTable(pieces.read_model(q.tokenizer()))
    for _, text in texts[:50]:
        encoder.encode(text or "")
    assert asked and len(asked) == len(set(asked))


def test_many_words_at_once_equal_the_library(texts, monkeypatch):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer())
    rng = random.Random(5)
    rows = [t or "" for _, t in texts[:200]] + ["", "x" * 500, "aaaa bbbb " * 40] + [
        "".join(rng.choice("abcdetheé ß漢字😀▁\n\t\x00ĀЖ") for _ in range(rng.randint(0, 60))) for _ in range(800)]
    whole, alone = [], pieces.PieceTable.word_ids
    monkeypatch.setattr(pieces.PieceTable, "word_ids", lambda self, w: whole.append(w) or alone(self, w))
    for kept, together in [(pieces.WORDS_KEPT, pieces.TOGETHER), (50, 5000)]:
        monkeypatch.setattr(pieces, "WORDS_KEPT", kept)
        monkeypatch.setattr(pieces, "TOGETHER", together)
        encoder = pieces.PieceTable(pieces.read_model(q.tokenizer()))
        for x, got in zip(rows, encoder.encode_all(rows), strict=True):
            ids = library.encode(x, add_bos=True, add_eos=True)
            assert got == struct.pack(f"<{len(ids)}I", *ids)
        assert len(encoder.known) <= kept
        if together == pieces.TOGETHER > 5000:
            # All in one stretch: only long words and those with characters that are no pieces go one by one.
            assert whole and all(len(w) > pieces.LONG_WORD or any(c not in encoder.ids for c in w) for w in whole)


def test_pieces_are_encoded_and_decoded_in_one_worker(spark, small):
    plan = q.QUERIES["op4_sentencepiece"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_pieces_decode_any_ids():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=q.tokenizer())
    table, rng = pieces.PieceTable(pieces.read_model(q.tokenizer())), random.Random(1)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(300), rng.randrange(32000)]) for _ in range(6)]
        assert table.decode(struct.pack("<6I", *ids)) == library.decode(ids)


def url_brute(url, entries):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [e for e in entries if (host == e[1] or host.endswith("." + e[1])) and path.startswith(e[2])]
    best = max(fits, key=lambda e: (len(e[1] + e[2]), len(e[1]), e[0] == "block"), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


@pytest.mark.parametrize("limit", [urls.TRIE_BYTES, 0])
def test_urls_by_trie_and_by_join(spark, limit):
    rng = random.Random(3)
    hosts = [".".join(rng.choice(["a", "b", "com", "net", "www"]) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    paths = ["", "/", "/x", "/x/", "/x/y", "/xy/z", "/é/"]
    entries = [*q.URL_RULES, *{(rng.choice(["allow", "block"]), h, rng.choice(paths)) for h in hosts}]
    made = [f"{rng.choice(['http', ''])}://{h.upper() if rng.random() < 0.2 else h}{rng.choice(paths)}{rng.choice(['', '?q=/x', '#f', 'tail'])}"
            for h in hosts for _ in range(8)]
    made += [None, "", "no scheme", "://", "http://?x", "http://com"]
    df = spark.createDataFrame([(i, u, "old", [2]) for i, u in enumerate(made)], "id int, url string, rule string, extra array<int>")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, entries, trie_bytes=limit).collect()}
    assert got == {i: url_brute(u, entries) for i, u in enumerate(made)}


def test_next_rows_and_fingerprints(spark, small, texts):
    for depth in (1000, 30):
        docs = common.table(spark, small, "documents")
        rows = simhash.with_next(docs, ["text"], depth=depth).collect()
        follow = {k: t for (k, _), (_, t) in zip(texts, texts[1:] + texts[:1])}
        assert {r.doc_id: r.next_text for r in rows} == follow and len(rows) == len(texts)
    got = q.QUERIES["op1_simhash"](spark, small).collect()
    prints = {r.doc_id: r.fingerprint for r in got}
    like = lambda a, b: 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128
    for i, (key, text) in enumerate(texts):
        after_key, after = texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = next(x for x in got if x.doc_id == key)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == simhash.fingerprint(text.encode())
        assert r.edited_fingerprint == simhash.fingerprint(edited.encode())
        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint))
        assert r.near_next == pytest.approx(like(r.fingerprint, prints[after_key]))
    assert sum(r.near_edited > r.near_next for r in got) > 0.97 * len(got)


def test_next_of_one_row_ties_and_none(spark, odd):
    one = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    assert rows_of(simhash.with_next(one, ["text"])) == [(1, "x", "x")]
    assert simhash.with_next(one.where("false"), ["text"]).count() == 0
    order = sorted(
        odd.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect(),
        key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.tie, r.text is not None, r.text or ""),
    )
    want = Counter((a.doc_id, a.text, b.text) for a, b in zip(order, order[1:] + order[:1]))
    for depth in (None, 2):
        rows = simhash.with_next(odd, ["text"], depth=depth).collect()
        assert Counter((r.doc_id, r.text, r.next_text) for r in rows) == want


def test_next_where_one_id_holds_a_third(spark, monkeypatch):
    docs = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 77).otherwise(F.col("id") * 5 - 4000).alias("doc_id"),
        F.concat(F.lit("text "), F.col("id")).alias("text"),
    )
    cut = simhash.ranges(docs, ["text"], "doc_id", depth=50)
    sizes = [r["count"] for r in cut.groupBy("_segment").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 100 and len(sizes) < 150
    order = sorted(docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").collect())
    want = Counter((a.doc_id, a.text, b.text) for a, b in zip(order, order[1:] + order[:1]))
    for sent in (simhash.RANGES_SENT, 0):
        monkeypatch.setattr(simhash, "RANGES_SENT", sent)
        got = simhash.with_next(docs, ["text"], depth=50).collect()
        assert Counter((r.doc_id, r.text, r.next_text) for r in got) == want


def test_block_tables_find_all_pairs(spark):
    rng = random.Random(5)
    prints = []
    for _ in range(30):
        base = rng.getrandbits(128)
        prints.append(base)
        for _ in range(4):
            x = base
            for bit in rng.sample(range(128), rng.randint(1, 8)):
                x ^= 1 << bit
            prints.append(x)
    hexes = [f"{x:032x}" for x in prints] + [f"{prints[0]:032x}", None]
    df = spark.createDataFrame([(h,) for h in hexes], "fingerprint string")
    for radius in (1, 3, 6):
        got = {(r.a, r.b): r.bits for r in simhash.near_pairs(df, radius).collect()}
        known = sorted({h for h in hexes if h})
        want = {(a, b): d for i, a in enumerate(known) for b in known[i + 1 :]
                if (d := bin(int(a, 16) ^ int(b, 16)).count("1")) <= radius}
        assert got == want and want


@pytest.mark.parametrize("folder", ["small", "middle"])
def test_search_by_tables_equals_all_pairs_of_whole_tables(spark, folder, request):
    rows = q.QUERIES["op1_simhash"](spark, request.getfixturevalue(folder)).collect()
    prints = [int(r.fingerprint, 16) for r in rows]
    assert len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        near = sum(bin(int(r.fingerprint, 16) ^ p).count("1") <= q.NEAR_BITS for p in prints) - 1
        assert r.near_rows == (near if r.doc_id % 100 == 0 else None)


def test_rows_near_with_copies_nulls_and_none(spark):
    rng = random.Random(7)
    bases = [rng.getrandbits(128) for _ in range(12)]
    made = [b ^ sum(1 << bit for bit in rng.sample(range(128), rng.randint(0, 7))) for b in bases for _ in range(9)]
    made += made[:20] + [made[0]] * 50
    rows = [(i, f"{x:032x}") for i, x in enumerate(made)] + [(None, f"{made[0]:032x}"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, fingerprint string")
    for radius in (1, 3, 5):
        got = {r.fingerprint: r.near_rows for r in simhash.near_rows(df, F.col("doc_id") % 3 == 0, radius).collect()}
        full = [int(f, 16) for _, f in rows if f]
        asked = {f for k, f in rows if f and k is not None and k % 3 == 0}
        want = {f: sum(bin(int(f, 16) ^ p).count("1") <= radius for p in full) - 1 for f in asked}
        assert got == want and max(want.values()) > 50
    assert simhash.near_rows(df.where("false"), F.lit(True), 3).count() == 0


def vote_by_vote(text):
    """A fingerprint bit by bit: every term's hash in turn, with its weight."""
    words = [zlib.crc32(w) + 1 for w in text.lower().split()]
    mask, odd = (1 << 64) - 1, [int(x) for x in simhash._ODD]

    def mixed(h, by):
        h = h * odd[by] & mask
        h = (h ^ h >> 29) * odd[by + 1] & mask
        return h ^ h >> 32

    words, votes = [mixed(w, 0) for w in words], [0.0] * 128
    triples = [mixed(mixed(a ^ b, 2) ^ c, 2) for a, b, c in zip(words, words[1:], words[2:])]
    for found, weight in ((Counter(words), 0.5), (Counter(triples), 1.0)):
        for h, n in found.items():
            stream = b"".join(mixed(h, by).to_bytes(8, "little") for by in (4, 6))
            for bit in range(128):
                votes[bit] += weight * (1 + math.log(n)) * (1 if stream[bit // 8] >> 7 - bit % 8 & 1 else -1)
    return sum(1 << 127 - bit for bit in range(128) if votes[bit] > 1e-9)


def test_fingerprints_equal_votes_one_by_one(texts):
    for text in [t.encode()[:3000] for _, t in texts[:25]] + [b"", b"one", b"a b", b"a a a a b", b"A B c"]:
        assert simhash.fingerprint(text) == f"{vote_by_vote(text):032x}"


def test_base_scores_by_hand(spark, small, texts, odd):
    def tokens(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x20\x09-\x0D]+", low) + ["\n"]

    def check(rows, got):
        aside = lambda k: zlib.crc32(str(k).encode()) % 7 == 2 if k is not None else zlib.crc32(b"") % 7 == 2
        counts = Counter(w for k, t in rows if not aside(k) for w in tokens(t))
        n, v = sum(counts.values()), len(counts)
        want = sorted(((k if k is not None else -1, aside(k), len(w := tokens(t)), sum(counts[x] > 0 for x in w), n,
                        sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)) for k, t in rows))
        have = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
        assert [h[:5] for h in have] == [w[:5] for w in want]
        assert [h[5] for h in have] == pytest.approx([w[5] for w in want], abs=1e-6)

    check(texts, q.QUERIES["op3_brown_lm"](spark, small).collect())
    few = brown.score(odd, common.remainder("doc_id", 7) != 2, held=3, words=5, pools=4, classes=3)
    check([(r.doc_id, r.text) for r in odd.collect()], few.withColumn("held_out", ~F.col("trained")).collect())
    assert brown.score(odd.where("false"), F.lit(True)).count() == 0


def test_class_probabilities_sum_to_one_and_beat_single_words(spark, middle):
    docs = common.table(spark, middle, "documents").where("doc_id < 150").select("doc_id", "text")
    counts = brown.word_counts(docs)
    model, placed = brown.fit(counts, docs, words=60, pools=20, classes=8)
    step, mass = 10**model.step, 10**model.mass
    assert step.sum(1) == pytest.approx([1] * len(step))
    rows = {bytes(r.word): (r.n, r.kind) for r in placed.collect()}
    assert {w: n for w, (n, _) in rows.items()} == {bytes(r.word): r.n for r in counts.collect()}
    for c in range(1, 8):
        assert sum(n + 1 for n, k in rows.values() if k == c) + 1 == pytest.approx(mass[c])
    # The transitions are those of all words in the classes they chose, counted anew.
    grid = np.zeros((8, 8))
    texts = [brown.tokens((r.text or "").encode()) for r in docs.collect()]
    for toks in texts:
        seq = model.kind[model.types([brown.END, *toks[:-1]])]
        for a, w in zip(seq, toks):
            grid[a, rows[w][1]] += 1
    share = mass / mass.sum()
    assert step == pytest.approx((grid + brown.SMOOTHING * share) / (grid.sum(1, keepdims=True) + brown.SMOOTHING), rel=1e-6)
    # Words chose for themselves: pools do not stay together.
    pools = {}
    for w, (_, k) in rows.items():
        if w not in model.types.of:
            pools.setdefault(zlib.crc32(w[-3:]) % 20, set()).add(k)
    assert model.steps and max(map(len, pools.values())) > 1
    # Scores are the sums of these logarithms, whether words are sent or joined.
    for held in (10, 10**6):
        got = {r.doc_id: r.score for r in brown.score(docs, F.lit(True), held=held, words=60, pools=20, classes=8).collect()}
        for r in docs.collect():
            toks = brown.tokens((r.text or "").encode())
            seq = model.kind[model.types([brown.END, *toks[:-1]])]
            want = sum(model.step[a, rows[w][1]] - model.mass[rows[w][1]] + math.log10(rows[w][0] + 1) for a, w in zip(seq, toks))
            assert got[r.doc_id] == pytest.approx(want, abs=1e-5)
    rows = [r for r in q.QUERIES["op3_brown_lm"](spark, middle).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_words_of_many_texts_equal_those_of_each(texts):
    rng = random.Random(7)
    rows = [None, "", " ", "a", "\n a", "a b", "éA\x0bB\x1cc \x85x", "  x", "x", "", "A\r\n漢字"] + [t for _, t in texts[:50]] + [
        "".join(rng.choice("aBc é\n\t漢") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    whole = pa.array(rows, pa.string())
    for column in (whole, whole.slice(3, 200), whole.slice(0, 1), whole.slice(0, 0), pa.array(["", " "])):
        words, want = brown.Words(column), [brown.tokens((x or "").encode()) for x in column.to_pylist()]
        assert len(set(words.distinct.to_pylist())) == len(words.distinct)
        assert words.distinct.take(pa.array(words.place)).to_pylist() == [w for x in want for w in x]
        assert words.sizes.tolist() == [len(x) for x in want]
        types = brown.Types([b"a", "é".encode()], 5)
        for kind, w in zip(types(words.distinct), words.distinct.to_pylist(), strict=True):
            assert kind == types.of.get(w, 3 + zlib.crc32(w[-3:]) % 5)


def test_contexts_are_counted_once_for_each_word(spark, texts):
    rows = [(t,) for _, t in texts[:40]] * 3 + [(None,), ("",)]
    docs = spark.createDataFrame(rows, "text string").repartition(5)
    frequent = [b"the", b"of"]
    model = brown.ClassModel(brown.Types(frequent, 6), np.array([0, 1, 2, 1, 2, 1, 2, 0, 1]), 3)
    want = {}
    for (t,) in rows:
        toks = brown.tokens((t or "").encode())
        for a, w in zip(model.kind[model.types([brown.END, *toks[:-1]])].tolist(), toks):
            if w not in model.types.of:
                want.setdefault(w, Counter())[a] += 1
    # Small stretches, so that words lie in many rows and across batches.
    got = brown.context_counts(docs, model, together=3000, rows=1).collect()
    assert {bytes(r.word): dict(zip(r.contexts, r.times)) for r in got} == want and len(got) == len(want)
    assert all(r.contexts == sorted(r.contexts) and r.pool == zlib.crc32(bytes(r.word)[-3:]) % 6 and r.half == zlib.crc32(r.word) & 1 for r in got)


def test_words_choose_the_best_class_of_their_own_counts():
    rng = np.random.default_rng(2)
    model = brown.ClassModel(brown.Types([], 4), np.array([0, 1, 2, 3, 4]), 6)
    model.cost, model.steps = 0.5, [rng.normal(size=(6, 6)), rng.normal(size=(6, 6))]
    sizes = [1, 1, 1, 6, 2, 1, 3, 1] * 200
    contexts = np.concatenate([np.sort(rng.choice(6, n, replace=False)) for n in sizes])
    times, owner = rng.integers(1, 4, len(contexts)), np.repeat(np.arange(len(sizes)), sizes)
    pools, half = rng.integers(0, 4, len(sizes)), rng.integers(0, 2, len(sizes))
    got = model.chosen(pools, half, owner, contexts, times)
    for i in range(len(sizes)):
        sums = (model.steps[half[i]][contexts[owner == i]] * times[owner == i, None]).sum(0)
        old, best = model.kind[1 + pools[i]], 1 + int(np.argmax(sums[1:]))
        assert got[i] == (best if sums[best] > sums[old] + 0.5 else old)


def test_a_round_reads_only_the_half_that_chooses(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts[:60], "doc_id bigint, text string")
    halves, count = [], brown.class_counts
    monkeypatch.setattr(brown, "class_counts", lambda table, model, half: halves.append(half) or count(table, model, half))
    brown.fit(brown.word_counts(docs), docs, words=20, pools=5, classes=4, rounds=2)
    assert halves[:2] == [1, 0] and halves[2:] in ([], [1])


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    pairs = np.zeros((13, 13))
    for a in range(1, 13):  # odd types follow even ones
        for b in range(1, 13):
            pairs[a, b] = rng.integers(20, 40) if (a + b) % 2 else rng.integers(0, 3)
    kind = brown.exchange(pairs, classes=3)
    assert len(set(kind[1::2])) == 1 and len(set(kind[2::2])) == 1 and kind[1] != kind[2]


def test_rule_counts_by_hand(texts):
    for t in [t for _, t in texts] + ["", "a\na\n\n b\nb", "x y z x y z", "é#é $$\n", " a b c a b c a\r\x0b"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {i + d for i in range(len(words) - 2) for d in range(3) if windows[tuple(words[i : i + 3])] > 1}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert rules.base_counts(t.encode()) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def personal_brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_by_hand(texts):
    rng = random.Random(2)
    made = ["".join(rng.choice("0123456789..@@--+ ()ab%_é") for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    for t in [t for _, t in texts] + made:
        base = pii.base_spans(t)
        assert base == personal_brute(t)
        every = pii.all_spans(t, pii.trained())[1]
        assert set(base) <= set(every)
    assert pii.base_spans("9" * 50_000 + "@") == [] and not pii.base_spans("a" * 50_000)


def test_components_by_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 620)]
    root = {x: x for p in links for x in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    want = {x: top(x) for x in root if any(x in p and p[0] != p[1] for p in links)}
    assert dict(rows_of(components(spark.createDataFrame(links, "a int, b int")))) == want
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def common_run(a, b):
    """Words of the longest list that both have in order, by plain dynamic programming."""
    line = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, start=1):
            diagonal, line[j] = line[j], diagonal + 1 if x == y else max(line[j], line[j - 1])
    return line[-1]


def near_brute(texts):
    """Classes by the similarity of all pairs."""
    m = [(t or "").encode().lower().split() for t in texts]
    fives = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in m]
    root = list(range(len(texts)))
    for i in range(len(m)):
        for j in range(i):
            if m[i] == m[j] or (fives[i] & fives[j] and 2 * common_run(m[i], m[j]) >= 0.8 * (len(m[i]) + len(m[j]))):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return root


@pytest.mark.parametrize("stride", [4096, 3])
def test_alignment_equals_plain_dynamic_programming(stride, monkeypatch):
    monkeypatch.setattr(orderhash, "STRIDE", stride)
    rng = random.Random(8)
    for _ in range(300):
        a = [bytes([rng.randrange(6)]) for _ in range(rng.randint(0, 30))]
        b = [w if rng.random() < 0.8 else bytes([rng.randrange(6)]) for w in a if rng.random() < 0.9]
        want = common_run(a, b)
        assert orderhash.matched(a, b, len(a) + len(b)) == want
        least = len(a) + len(b) - 2 * want  # a band that the alignment needs
        assert orderhash.matched(a, b, least) == want
    long = [str(i % 977).encode() for i in range(30_000)]
    other = [b"x" if i % 11 == 0 else w for i, w in enumerate(long)]
    assert orderhash.similarity(long, other) == pytest.approx(2 * sum(map(bytes.__eq__, long, other)) / 60_000, abs=0.002)


def variants(rng, groups=6, copies=9):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(60)]
        out.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            out.append(" ".join(w))
        out.append(" ".join(base[30:] + base[:30]))  # the same shingles in another order
    return out


@pytest.mark.parametrize("cell", [128, 4])
def test_near_classes_equal_all_pairs(spark, odd, cell, monkeypatch):
    monkeypatch.setattr(orderhash, "CELL", cell)
    made = variants(random.Random(11))
    made += [r.text for r in odd.collect() if len(r.text or "") < 1000]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in orderhash.classes(docs).collect()}
    root = near_brute(made)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert {i: r.class_id for i, r in got.items()} == {i: least[r] for i, r in enumerate(root)}
    assert all(r.kept == (i == r.class_id) for i, r in got.items())
    assert {i: r.class_rows for i, r in got.items()} == {i: root.count(root[i]) for i in got}


@pytest.mark.parametrize("cell", [128, 4])
def test_short_near_copies_equal_all_pairs(spark, cell, monkeypatch):
    monkeypatch.setattr(orderhash, "CELL", cell)
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    frame = [word() for _ in range(60)]  # words that many texts share
    made = []
    for n in [*range(5, 21), 25, 30, 34, 35, 36, 37, 40]:
        for _ in range(4):
            base = [word() for _ in range(n)]
            made += [base, base + [word()], [word()] + base[1:], base[: n // 2] + [word()] + base[n // 2 + 1 :]]
        made += [frame[:n] + [word()], [word()] + frame[:n] + [word()]]
        base = [word() for _ in range(n)]
        made += [base, base + [word() for _ in range((n - 4) // 4)]]  # as far apart as near copies may be
    made = [" ".join(w) for w in made]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in orderhash.classes(docs).collect()}
    root = near_brute(made)
    least = {}
    for i, r in enumerate(root):
        least.setdefault(r, i)
    assert got == {i: least[r] for i, r in enumerate(root)}


def test_near_classes_of_odd_rows(spark, odd):
    got = orderhash.classes(odd, keep=["lang"]).collect()
    assert len(got) == odd.count()
    assert orderhash.classes(odd.where("false")).count() == 0


def test_words_and_mixes_of_odd_rows(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    total = sum(r["size"] for r in got)
    by_source = {}
    for r in mixing.mix(odd.drop("taken"), keep=["source", "text"]).collect():
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.taken <= 3 * r["size"]
        s = by_source.setdefault(r.source, [0, r.target, r.source_size])
        s[0] += r.taken
    for taken, target, size in by_source.values():
        assert abs(taken - target) <= 0.5 and target <= 3 * size
    assert sum(t for _, t, _ in by_source.values()) == pytest.approx(total)
    assert mixing.mix(odd.where("false")).count() == 0


def test_repeated_ids_and_rows_are_spread_and_reruns_agree(spark, monkeypatch):
    rows = [(7, f"w{i} " * (i % 5 + 1), "a") for i in range(3000)] + [(i, "x y z", "a") for i in range(6000)]
    rows += [(8, "the same row", "a")] * 4000 + [(9, "another same row here", "a")] * 3000 + [(i, "b c", "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    steps = {}
    monkeypatch.setattr(mixing, "saved", lambda df, name: steps.setdefault((len(steps), name), common.saved(df, name)))
    found = Counter(map(tuple, mixing.mix(df).collect()))
    mean = 16_000 / 127
    assert max(n for (_, name), x in steps.items() if name == "mix-ranges" for (n,) in x.select("_n").collect()) > 3000
    assert any(name == "mix-often" for _, name in steps)
    # No window's rows are more than a few times the average.
    windows = {}
    real = mixing._apart
    monkeypatch.setattr(mixing, "_apart", lambda *a: windows.setdefault("rows", real(*a)))
    again = Counter(map(tuple, mixing.mix(df.repartition(3)).collect()))
    assert found == again
    sizes = [r["count"] for r in windows["rows"].groupBy("_source", "_range", "_part", "_share").count().collect()]
    assert max(sizes) < 10 * max(mean, mixing.FEW / 8) and sum(sizes) == len(rows)
    total = sum(len(t.split()) for _, t, _ in rows)
    assert abs(sum(r[4] * n for r, n in found.items()) - total) <= 2
    monkeypatch.setattr(mixing, "FEW", 10**9)  # no range is looked into
    assert Counter(map(tuple, mixing.mix(df).collect())) == found


def test_materialized_mix_has_the_words_taken(spark, odd):
    plan = Counter()
    for r in mixing.mix(odd).collect():
        plan[r.doc_id] += r.taken
    rows = mixing.materialized(odd).collect()
    words = Counter()
    for r in rows:
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in plan.items() if v}
    known = [r.text for r in odd.collect()]
    assert all(r.text in known or any((t or "").startswith(r.text) for t in known) for r in rows)


def test_parts_that_a_leader_does_not_join_are_joined(spark, monkeypatch):
    """Chains of texts with coarse keys: leaders leave parts open, and comparing in blocks joins whole parts."""
    monkeypatch.setattr(orderhash, "CELL", 8)
    steps = {}
    monkeypatch.setattr(orderhash, "saved", lambda df, name: steps.setdefault(name, common.saved(df, name)))
    rng = random.Random(21)
    made = []
    for _ in range(4):
        line = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(330)]
        made += [" ".join(line[9 * i : 9 * i + 120]) for i in range(20)]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id bigint, text string")
    rows = common.saved(orderhash.sketched(docs, "doc_id", "text", 3, 1, []), "sketches")
    links, whole = orderhash.near_links(rows)
    assert not steps["more"].isEmpty()
    found = rows_of(whole)
    got = dict(found)
    assert len(found) == len(got)
    # The components are those of the links, by their least node.
    root = {x: x for r in rows_of(links) for x in r[:2]}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b, _ in rows_of(links):
        low, high = sorted((top(a), top(b)))
        root[high] = low
    assert got == {x: top(x) for x in root}
    # They are those of all pairs that share a key.
    of = {r["_key"]: (bytes(r["node"]), set(r["keys"])) for r in rows.collect()}
    words = {i: orderhash.words_of(t.encode()) for i, t in enumerate(made)}
    want = {of[i][0]: of[i][0] for i in of}
    for i in of:
        for j in range(i):
            if of[i][1] & of[j][1] and orderhash.similarity(words[i], words[j]) >= 0.8:
                a, b = want[of[i][0]], want[of[j][0]]
                want = {x: min(a, b) if r in (a, b) else r for x, r in want.items()}
    lone = {x: bytes(got.get(x, x)) for x in want}
    assert lone == want
