"""Secret scans, spelling variants and lexical search, against plain Python."""

import base64
import collections
import functools
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import lexical_search, secret_scans, spelling

SCHEMA = "doc_id long, text string, id string, word string, key string, term int, item int, score int, root string"
REST = ("x", "y", "z", 1, 2, 3, "r")
EDGES = [None, "", " \n", ".", "a", "AKIA"]
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(saved, texts, parts=2, ids=None):
    return saved([(k if ids is None else ids[k], t, *REST) for k, t in enumerate(texts)], SCHEMA, parts)


# Secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_secrets(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, "access", m.end(), m.group()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end(), m.group()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def brute_secrets(texts, sample=secret_scans.SAMPLE, least=secret_scans.MIN_LLR):
    """kind:start:end of all spans of each text; models as dictionaries of pairs."""
    base = [base_secrets(t) for t in texts]
    free = lambda b, s, e: not any(x[0] < e and s < x[3] for x in b)
    draw = lambda v: (hashlib.md5(v.encode()).hexdigest()[:8], v)
    mixed = lambda v: re.search("[A-Za-z]", v) and re.search("[0-9]", v)
    firsts = [(b, t, next((v for v in re.findall("[A-Za-z0-9+/_=-]{8,}", t or "") if not mixed(v)), None)) for b, t in zip(base, texts)]
    ordinary = sorted({v for b, t, v in firsts if v and free(b, t.find(v), t.find(v) + len(v))}, key=draw)[:sample]
    known = sorted({x[4] for b in base for x in b if len(x[4]) >= 16 and re.search("[0-9]", x[4])}, key=draw)[:sample]
    made = [f for v in ordinary for d in [hashlib.sha256(v.encode())] for f in (d.hexdigest()[:32], d.hexdigest()[:32].upper(), *(base64.b64encode(hashlib.sha256((v + more).encode()).digest()).decode() for more in ("", "+", "/")))]
    inside = set(secret_scans.ALPHABET)
    models = []
    for strings in (known + made, ordinary):
        pairs = collections.Counter(p for v in strings for p in zip(v, v[1:]) if set(p) <= inside)
        first, second = collections.Counter(), collections.Counter()
        for (a, b), n in pairs.items():
            first[a] += n
            second[b] += n
        models.append((pairs, first, second))
    share = lambda m, p: (m[0][p] + 20.0 * (m[2][p[1]] + 1) / (sum(m[2].values()) + 67)) / (m[1][p[0]] + 20.0)
    weight = functools.cache(lambda p: math.floor(1000 * math.log(share(models[0], p) / share(models[1], p))))
    out = []
    for b, t in zip(base, texts):
        spans = list(b)
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t or ""):
            v = m.group()
            if ordinary and re.search("[A-Za-z]", v) and free(b, m.start(), m.end()) and len(set(v)) >= 8 and sum(map(weight, zip(v, v[1:]))) >= least:
                spans.append((m.start(), 3, "random", m.end(), v))
        out.append(",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in sorted(spans)))
    return base, out


def secret_texts(n=40, seed=1):
    rng = random.Random(seed)
    syllables = ["con", "fig", "ur", "at", "ion", "get", "user", "in", "form", "ing", "er", "the", "and", "ac", "count"]
    words = ["".join(rng.choices(syllables, k=rng.randint(3, 7))) for _ in range(300)] + ["configuration", "getUserAccount", "house_of_cards", "thanonontioniner", "é", "naïve", "token", "key", "2024-01-01", "asadogaesiegaque", "information-technology"]
    odd = ["token=token: abcdefgh", "PASSWORD : 'hunter22'", 'api_key="x"', "apikey==abcdef1", "secret   =   abcdef.ghij", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 11, "0123456789abcdef01234567", "abcdef" * 5, "Token\t=abcdefgh", "ſecret=abcdefgh", "\U0001f600 token='aaaaaaa'"]
    texts = [*EDGES, *odd]
    for _ in range(n):
        own = rng.choices(words, k=rng.randint(3, 12))
        if rng.random() < 0.4:
            own.insert(rng.randrange(len(own)), base64.b64encode(rng.randbytes(24)).decode())
        if rng.random() < 0.3:
            own.insert(rng.randrange(len(own)), f'token = "{rng.randbytes(20).hex()}"')
        texts.append(" ".join(own))
    return texts


def test_secrets_against_brute_force(spark, saved):
    texts = secret_texts()
    docs = table(saved, texts)
    base, spans = brute_secrets(texts)
    got = secret_scans.digest(secret_scans.spans(docs)).orderBy("doc_id").collect()
    assert [r.spans for r in got] == spans and sum(r.n_random for r in got) > 10
    for r, b in zip(got, base):
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[2] == k for x in b) for k in secret_scans.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{x[2]}:{x[0]}:{x[3]}" for x in b).encode()).hexdigest()


def test_secrets_with_a_small_sample(spark, saved):
    texts = secret_texts(seed=2)
    got = secret_scans.digest(secret_scans.spans(table(saved, texts, 3), sample=5)).orderBy("doc_id").collect()
    assert [r.spans for r in got] == brute_secrets(texts, 5)[1]


def test_secrets_told_apart_on_held_out_strings(spark, sf_dir):
    """A model of the corpus finds nine of ten keys that it has not seen, and takes no word of the corpus for one."""
    rows = secret_scans.found(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    model = secret_scans.weights(secret_scans.labelled(rows))
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(letters, k=rng.randint(24, 48))) for _ in range(200)]
    names = [f"{a}{rng.choice('_-/')}{b}" for a, b in zip(*[iter(r.ordinary for r in rows.where("ordinary IS NOT NULL").limit(200).collect())] * 2)]
    values = spark.createDataFrame([(k, True) for k in keys] + [(n, False) for n in names if len(n) >= 20], "v string, random boolean")
    flagged = values.select("random", (secret_scans.score(F.col("v"), model) >= secret_scans.MIN_LLR).alias("found")).collect()
    assert sum(r.found for r in flagged if r.random) >= 180 and not any(r.found for r in flagged if not r.random)


def test_secrets_of_empty_tables_and_long_texts(spark, saved):
    assert secret_scans.digest(secret_scans.spans(spark.createDataFrame([], SCHEMA))).count() == 0
    long = "ordinary words everywhere " * 20_000 + "token=" + "a" * 1_000_000 + " " + "b" * 1_000_000
    docs = table(saved, [long, long, None], ids=[None, 7, 7])
    got = secret_scans.digest(secret_scans.spans(docs)).orderBy("doc_id").collect()
    start = 26 * 20_000
    spans = f"assign:{start}:{start + 1_000_006},hex:{start + 6}:{start + 1_000_006},hex:{start + 1_000_007}:{start + 2_000_007}"
    assert sorted(r.spans for r in got) == ["", spans, spans]


# Spelling variants


def damaged(doc, run):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    k = h % len(run)
    return run[:k] + run[k + 1 :] if h % 97 == 0 else run


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    counts = collections.Counter(damaged(d, run.translate(ASCII_LOWER)) for d, t in rows for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    vocab = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    form, out = {}, {}
    for w in vocab:
        near = [v for v in vocab if one_edit(v, w)]
        best = min(near, key=lambda v: (-vocab[v], v)) if near else None
        form[w] = best if best and vocab[best] >= 2 * vocab[w] else None
        out[w] = (vocab[w], len(near), form[w], vocab[best] if form[w] else None)
    for w in vocab:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def variant_texts(seed, n=80):
    rng = random.Random(seed)
    stems = ["colour", "centre", "naïveté", "aaaaa", "abcabcabc", "größe", "x" * 60, "ab" * 30, "Ünder"]
    words = []
    for _ in range(60):
        w = rng.choice(stems + words[-10:])
        k = rng.randrange(len(w))
        words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcxé") + w[k:], w[:k] + rng.choice("abcxé") + w[k + 1 :]]))
    pool = stems + words
    return [*EDGES, *(" ".join(rng.choices(pool, weights=[1 / (1 + k % 13) for k in range(len(pool))], k=30)) + rng.choice([". Ends", "", "!A-B-Colour"]) for _ in range(n))]


@pytest.mark.parametrize(("seed", "bucket", "long"), [(1, 1, 48), (2, 32, 8)])
def test_variants_against_brute_force(spark, saved, seed, bucket, long):
    texts = variant_texts(seed)
    ids = [None if k == 9 else k // 2 for k in range(len(texts))]
    docs = table(saved, texts, ids=ids)
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs, bucket=bucket, long=long).collect()}
    assert got == brute_variants(list(zip(ids, texts)))


def test_variants_damage_one_word_in_97(spark):
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(3000)]
    docs = spark.createDataFrame([(7, " ".join(words))], "doc_id long, text string")
    got = [r.word for r in spelling.occurrences(docs, "doc_id", "text").collect()]
    assert got == [damaged(7, w) for w in words] and 10 < sum(a != b for a, b in zip(got, words)) < 60


def test_variants_of_empty_tables_long_words_and_chains(spark, saved):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    chain = {"aaaaabbbbb"[: 10 - k]: 3 * 2**k for k in range(5)}
    docs = table(saved, [*[long] * 6, *[long[:77] + "z" + long[78:]] * 3, *[long[:-1]] * 3, " ".join(w for w, n in chain.items() for _ in range(n))], ids=[1000] * 13)
    want = brute_variants([(1000, w) for w in [*[long] * 6, *[long[:77] + "z" + long[78:]] * 3, *[long[:-1]] * 3, *(w for w, n in chain.items() for _ in range(n))]])
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in spelling.variants(docs).collect()} == want


def test_pairs_of_one_reduced_form(spark):
    """Many words of one reduced form make no pairs but those one edit apart."""
    own = {}
    for c, s in zip(spelling.LETTERS, spark.range(1).select(spelling.reduced(F.lit(spelling.LETTERS))).first()[0]):
        own.setdefault(s, []).append(c)
    alike = max(own.values(), key=len)
    rng = random.Random(5)
    words = sorted({"".join(rng.choices(alike, k=6)) for _ in range(3000)})
    vocab = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    got = {tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(vocab).collect()}
    gaps = collections.defaultdict(set)
    for w in words:
        for k in range(6):
            gaps[w[:k] + "?" + w[k + 1 :]].add(w)
    assert got == {(a, b) for g in gaps.values() for a in g for b in g if a < b}


# Lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(ASCII_LOWER))


def brute_search(docs, items, k=20):
    own = [(d, collections.Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in own]
    count, length = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for (d, c), n in zip(own, sizes):
            if not n:
                continue
            m = 75 + 25 * n * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(200)] + ["Über", "naïve", "x1"]
    weights = [1 / (k + 1) for k in range(len(vocab))]
    texts = [*EDGES, *(rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, weights, k=rng.choice([1, 3, 20, 200]))) for _ in range(n))]
    texts += [texts[20]] * 30
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([1, 5, 30])))) for k in range(25)] + [(25, None), (26, "..."), (27, "unknownterm"), (None, "w1 w2"), (3, "w3 W3 w3")]
    return texts, items


@pytest.mark.parametrize(("seed", "k", "rows", "block"), [(1, 20, 4096, 500_000), (2, 3, 7, 60), (3, 500, 32, 500_000)])
def test_search_against_brute_force(spark, saved, monkeypatch, seed, k, rows, block):
    monkeypatch.setattr(lexical_search, "ROWS", rows)
    texts, items = corpus(seed)
    ids = [None if j % 40 == 7 else 1000 - j // 2 for j in range(len(texts))]
    docs = table(saved, texts, 3, ids)
    bench = saved(items, "item_id int, text string", 1)
    got = found(lexical_search.search(docs, bench, k, block=block))
    assert got == brute_search(list(zip(ids, texts)), items, k)


def test_search_of_empty_tables_and_long_texts(spark, saved):
    none = spark.createDataFrame([], SCHEMA)
    item = spark.createDataFrame([(1, "alpha beta")], "item_id int, text string")
    assert lexical_search.search(none, item).count() == 0
    assert lexical_search.search(table(saved, EDGES), item.limit(0)).count() == 0
    texts = ["alpha " * 500_000 + "beta", "beta", "q" * 3_000_000, "alpha", "alpha"]
    docs = table(saved, texts)
    assert found(lexical_search.search(docs, item)) == brute_search(list(enumerate(texts)), [(1, "alpha beta")])
