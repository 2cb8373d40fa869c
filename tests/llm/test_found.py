"""Secrets, spelling variants and hard negatives: SQL on the tables, brute force on made and odd rows."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_exact import against_sql
from tidewheel.llm import credentials, negatives, spelling
from tidewheel.llm import queries as q


@pytest.mark.parametrize("name", ["op11_credentials", "op12_spelling", "op13_negatives"])
def test_queries_equal_their_sql(spark, small, name):
    against_sql(q.QUERIES[name](spark, small), q.ORACLES[name], small)


def base_brute(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]


def spans_brute(t, reach):
    base = base_brute(t)
    weak = []
    for m in re.finditer(credentials.WEAK, t):
        run = m[4]
        if run and not all(re.search(c, run) for c in ("[0-9]", "[A-Z]", "[a-z]")):
            continue
        weak.append((m.start(), 5 if m[1] else 3 if m[2] else 4, m.end()))
    weak = [w for w in weak if not any(s < w[2] and w[0] < e for s, _, e in base)]
    role = lambda k: {1: "id", 3: "id", 5: "at"}.get(k, "secret")
    out = list(base)
    for s, k, e in weak:
        near = {role(j) for a, j, b in base + weak if (a, j, b) != (s, k, e) and a <= e + reach and b >= s - reach}
        if {3: "secret" in near, 4: bool(near & {"id", "at"}), 5: {"id", "secret"} <= near}[k]:
            out.append((s, k, e))
    return sorted(base), sorted(out)


def written(spans):
    return ",".join(f"{credentials.KINDS[k]}:{s}:{e}" for s, k, e in spans)


PIECES = [
    "token: token: abcdefgh", "PassWord = 'hunter22'", "api_key=abc", "apikey: x.y-z/12", "AKIA" + "Q" * 16, "AKIAQQ", "AKIA" + "Z9" * 5,
    "0123456789abcdef01234567", "0123456789abcdef0123456", "user=bob", "client_id: 77-a", "pwd = longenough1", "https://api.example.com/v1?x=1",
    "host=db.local:5432", "aB3" * 8, "abcdef" * 6, "é漢😀", "\n\n", "ſecret = abcdefgh", "key:", "toKen='a+b/c=_'", "word " * 9, " ", "x" * 40,
]


def test_credentials_by_brute_force(spark, odd):
    rng = random.Random(11)
    texts = ["".join(rng.choice(PIECES) + rng.choice([" ", "", "\n", "; "]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    texts += ["user=bob " + "x" * gap + " " + "aB3" * 8 for gap in range(30, 300)]
    texts += [None, "", "token=abcdef " * 3000, "user=a pwd=bcdefgh " * 2000, texts[0], texts[0]]
    df = spark.createDataFrame([(i // 2 if i % 7 else None, t, i, "clash") for i, t in enumerate(texts)], "id int, body string, n_hex int, place string")
    got = credentials.find(df, "body", keep=["id", "place", "n_hex"])
    assert got.columns == ["id", "place", "n_assign", "n_access", "n_hex", "base_spans", "spans"]
    want = Counter()
    for i, t in enumerate(texts):
        base, every = spans_brute(t or "", credentials.REACH)
        kinds = [k for _, k, _ in base]
        want[(i // 2 if i % 7 else None, "clash", *map(kinds.count, range(3)), written(base), written(every))] += 1
    assert Counter(map(tuple, got.collect())) == want
    assert any("ident" in w[-1] for w in want) and any("endpoint" in w[-1] for w in want)
    assert credentials.find(odd).count() == odd.count()
    assert credentials.find(odd.where("false")).count() == 0


def test_credentials_use_no_python(spark, small):
    plan = q.QUERIES["op11_credentials"](spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|InArrow|InPandas|CartesianProduct|NestedLoop", plan)


def words_brute(rows):
    counts = Counter()
    for key, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}

    def near(u, v):
        if abs(len(u) - len(v)) > 1 or u == v:
            return False
        if len(u) > len(v):
            u, v = v, u
        at = next((i for i, (a, b) in enumerate(zip(u, v)) if a != b), len(u))
        return u[at + (len(u) == len(v)) :] == v[at + 1 :]

    out = {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = [n[w], len(found), form, form and n[form]]
    for w, row in out.items():
        root = w
        while out[root][2] is not None:
            root = out[root][2]
        row.append(root)
    return {w: tuple(r) for w, r in out.items()}


@pytest.mark.parametrize("long", [32, 9])
def test_spelling_by_brute_force(spark, odd, long):
    rng = random.Random(12)
    abc = "abcÀÿ"
    base = ["".join(rng.choice(abc) for _ in range(rng.randint(7, 12))) for _ in range(40)] + ["aaaaaaaa", "ab" * 20, "ba" * 20 + "c", "x" * 300]
    words = []
    for w in base:
        words += [w] * rng.choice([1, 2, 30, 400])
        for _ in range(5):
            at, v = rng.randrange(len(w)), w
            v = rng.choice([v[:at] + v[at + 1 :], v[:at] + rng.choice(abc) + v[at:], v[:at] + rng.choice(abc) + v[at + 1 :]])
            words += [v] * rng.choice([1, 2, 25])
    rng.shuffle(words)
    rows = [(i if i % 9 else None, " ".join(words[i * 20 : i * 20 + 20]).replace("a", rng.choice("aA"))) for i in range(len(words) // 20 + 1)]
    rows += [(r.doc_id, r.text) for r in odd.collect()] + [rows[5], rows[5]]
    df = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id int, text string, word string")
    got = {r.word: tuple(r)[1:] for r in spelling.variants(df, long=long).collect()}
    want = words_brute(rows)
    assert got == want
    assert len({r[4] for r in want.values()}) < len(want) and any(out[2] and want[out[2]][2] for out in want.values())


def test_spelling_of_nothing(spark, odd):
    assert spelling.variants(odd.where("false")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short words")], "doc_id int, text string")).count() == 0


def test_products_of_packed_numbers_are_exact():
    rng = np.random.default_rng(13)
    for size, top in ((64, 256), (3, 5), (8, 1 << 20), (64, 1 << 30)):
        for n in (1, 2, 7, 50):
            a, r = (rng.integers(-top, top, (k, size)).astype(float) for k in (5, n))
            want = [[sum(int(x) * int(y) for x, y in zip(p, s)) for s in r] for p in a]
            assert negatives.scores(a, r).tolist() == want
    a, r = (np.array([[-(10**30), 3], [4, 10**25]], object) for _ in range(2))
    assert negatives.scores(a, r)[0, 1] == -4 * 10**30 + 3 * 10**25
    numbers = [0, 1, -1, 255, 256, -255, -256, -257, 1 << 70, -(1 << 70), 10**90, -(10**90)]
    assert sorted(numbers, key=negatives.sortable) == sorted(numbers)
    assert [negatives.unsorted(negatives.sortable(x)) for x in numbers] == numbers


def negatives_brute(rows):
    kept = []
    for key, vector, label in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if key is not None and key % 7 == 0 else label
        kept.append((key, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in vector), label))
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = Counter()
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    for key, vector, label in sorted(set(k for k in kept if k[0] is not None and k[0] % 50 == 0)):
        others = [(sum(x * y for x, y in zip(vector, v)), k, lab) for k, v, lab in kept if k != key and len(v) == len(vector)]
        for score, pos, _ in sorted((o for o in others if o[2] == label), key=order)[:5]:
            fit = [o for o in others if o[2] != label and 50 * score <= 100 * o[0] <= 95 * score]
            for rank, (s, neg, _) in enumerate(sorted(fit, key=order)[:3], start=1):
                out[key, pos, rank, neg, clip(score), clip(s)] += 1
    return out


@pytest.mark.parametrize("rows_per_block, anchors_per_block", [(4096, 1024), (16, 2)])
def test_negatives_by_brute_force(spark, rows_per_block, anchors_per_block):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * 0.3 + 0.5).round(1).tolist(), int(rng.integers(0, 3))) for i in range(220)]
    rows += [(300 + i, [0.5] * 6, 1) for i in range(40)] + [(100, rows[100][1], rows[100][2]), (150, [1.0] * 6, 2), (None, [0.5] * 6, 0)]
    rows += [(400, None, 1), (450, [0.1, None], 1), (500, [0.1, float("nan")], 2), (550, [float("inf")] * 6, 1), (600, [0.5] * 6, None)]
    rows += [(650, [0.5, 0.25], 1), (651, [0.5, 0.25], 1), (653, [0.25, 0.25], 2), (700, [], 1), (701, [], 1), (702, [], 2)]
    rows += [(750, [3e37, 1e30], 1), (751, [3e37, -1e30], 1), (752, [2e37, 1e30], 2), (753, [2.5e37, 0.0], 2)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<float>, label int, rank string")
    got = negatives.hard_negatives(df, rows_per_block=rows_per_block, anchors_per_block=anchors_per_block)
    assert Counter(map(tuple, got.collect())) == negatives_brute(rows)
    assert negatives.hard_negatives(df.where("false")).count() == 0
    assert negatives.hard_negatives(df.where("label = 1 and vec_id % 7 > 0")).count() == 0
