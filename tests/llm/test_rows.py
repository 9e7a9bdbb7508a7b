"""Operators that work on each row alone, against plain Python."""

import collections
import random
import re
import weakref
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, lm_scoring, packing, pii, quality_rules, suffixes, token_counts, tokens
from millrace.llm import textrows as tr

P = pytest.importorskip("public_tokenizers")
EDGES = [None, "", " ", "\n\n", "one", "one two three", "ab " * 3000, "x" * 20_000, "a\x0bb\x0cc\x1fd e", "é ü 漢字 🙂 🙂"]
SCHEMA = "doc_id long, text string, n_words string, kept int, id int, uid int"


def docs(saved, texts):
    rows = [(k, t, "clash", 1, 2, 3) for k, t in enumerate(texts)] + [(0, texts[0], "clash", 1, 2, 3), (None, texts[-1], None, None, None, None)]
    return saved(rows, SCHEMA), rows


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def mixed_texts(n=60, seed=1):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "Ünder", "to", "x#", "1|2", "long", "word", "here", "a", "b"]
    out = []
    for _ in range(n):
        body = [" ".join(rng.choices(vocab, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.4 and body:
            body += [rng.choice(body)] * rng.randint(1, 3)
        out.append("\n".join(body))
    return out


def test_suffixes_against_sorting():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(0, 12) for _ in range(4)]
        seqs = [[rng.randint(0, 2) for _ in range(n)] for n in sizes]
        flat = np.array([x for s in seqs for x in s], np.int64)
        of = np.repeat(np.arange(4), sizes)
        end = np.repeat(np.cumsum(sizes), sizes)
        got = suffixes.Suffixes(of, flat, end).longest()
        at = 0
        for s in seqs:
            for i in range(len(s)):
                best = 0
                for j in range(len(s)):
                    k = 0
                    while i != j and max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                        k += 1
                    best = max(best, k)
                assert got[at + i] == best
            at += len(s)


def brute_quality(text, limits=quality_rules.Limits()):
    w = words_of(text)
    count = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
    twice = {k for j in range(len(w) - 4) if count[tuple(w[j : j + 5])] > 1 for k in range(j, j + 5)}
    longest, inside = 0, set()
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        longest = max(longest, best)
        if best >= limits.min_repeat:
            inside |= set(range(i, i + best))
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    failed = len(w) < 10 or 100 * len(twice) > 20 * len(w)
    bad = len(inside) > limits.max_covered * len(w) or (longest > limits.max_longest and longest > limits.max_longest_share * len(w))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(twice), len(inside), longest, failed, not failed and not bad


def test_quality_rules(spark, saved):
    texts = [t for t in EDGES if len(t or "") < 5000] + mixed_texts()
    table, rows = docs(saved, texts)
    got = sorted((tuple(r) for r in quality_rules.rules(table).collect()), key=repr)
    assert got == sorted(((r[0], *brute_quality(r[1])) for r in rows), key=repr)
    kept = quality_rules.keep(table)
    assert kept.columns == table.columns
    assert kept.count() == sum(brute_quality(r[1])[-1] for r in rows)
    assert quality_rules.rules(table.limit(0)).count() == 0


def test_quality_method_verdict():
    """A long repeat below the share of the simple rule is the method's own case."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    passage = fresh(80)
    text = " ".join(passage + fresh(600) + passage)
    clean = " ".join(fresh(400))
    limits = quality_rules.Limits(max_window_share=0.5, max_covered=0.4)
    m = quality_rules.measures(pa.array([text, clean]), limits).to_pydict()
    assert m["base_failed"] == [False, False] and m["kept"] == [False, True] and m["longest_repeat"][0] == 80


def test_packing_round_trip(spark, saved):
    path = P.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    table, rows = docs(saved, [*EDGES, "word, " * 5000, "a <|endoftext|> b"])
    got = packing.pieces(table, path).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048 for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
    want = collections.defaultdict(list)
    for r in rows:
        want[r[0]].append([*whole.encode(r[1] or "", add_special_tokens=False).ids, 1])
    for doc, lists in want.items():
        parts = sorted(by[doc])
        if len(lists) == 1:
            ids = np.frombuffer(b"".join(p[1] for p in parts), "<u4").tolist()
            assert ids == lists[0] and all(p[2] == len(ids) for p in parts)
            assert [p[0] for p in parts] == np.append(0, np.cumsum([len(p[1]) // 4 for p in parts]))[:-1].tolist()
        else:
            assert sum(len(p[1]) for p in parts) == 4 * sum(map(len, lists))
    assert packing.pieces(table.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(table, path, longest=1000)


def test_packing_buckets(spark, saved, tmp_path):
    table, _ = docs(saved, ["some words " * 50, "few"])
    packed = packing.pieces(table, P.path("byte_bpe_50k.json"))
    packing.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == packed.count() and back.where("bucket <> length").count() == 0


def test_encoder_loads_tokenizers_for_special_texts_only():
    fast = tokens.Encoder(P.path("byte_bpe_50k.json"))
    fast.encode(pa.array(["plain words", None, ""]))
    assert "tokenizer" not in vars(fast)
    fast.encode(pa.array([f"some {fast.special[0].decode()} text"]))
    assert "tokenizer" in vars(fast)


def test_encoder_is_exact_on_odd_texts():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    whole, fast = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(4)
    alphabet = [" ", "  ", "a", "B", "é", "\n", "\t", " ", "漢", "1", ".", "'s", " ", "ß", "<|endoftext|>", "\x1f", "я", "\x7f", "\u0085", "word"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(2000)]
    ids, bounds = fast.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids


def test_token_counts_against_tokenizers(spark, saved):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = P.path("piece_bpe_32k.model")
    space = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    exact = Tokenizer(models.Unigram(token_counts.vocabulary(path), 0, True))
    exact.pre_tokenizer = space
    table, rows = docs(saved, [*EDGES, "▁", "a▁b", "<s> <unk> x", "\x00 tail  ", *mixed_texts(20)])
    got = sorted(map(tuple, token_counts.counts(table, path).collect()), key=repr)
    assert got == sorted(((r[0], len(exact.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows), key=repr)
    rng = random.Random(5)
    for fallback in (False, True):
        for _ in range(100):  # small scores make many ties
            pieces = list(dict([("<unk>", 0.0)] + [("".join(rng.choices("ab▁c", k=rng.randint(1, 4))), -float(rng.randint(1, 3))) for _ in range(12)]).items())
            small = Tokenizer(models.Unigram(pieces, 0, fallback))
            small.pre_tokenizer = space
            texts = ["".join(rng.choices("abcd é", k=rng.randint(0, 12))) for _ in range(20)]
            assert token_counts.Counter(pieces, 0, fallback).texts(pa.array(texts)).tolist() == [len(small.encode(t).ids) for t in texts]


def test_token_counts_of_long_units(spark, saved, monkeypatch):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = P.path("piece_bpe_32k.model")
    pieces = token_counts.vocabulary(path)
    exact = Tokenizer(models.Unigram(pieces, 0, True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rng = random.Random(7)
    long = ["".join(rng.choices(letters, k=size)) for letters in ("abcdetion", "ab☃", "☃", "日本語のa") for size in (4095, 4112, 30_000)]
    table, rows = docs(saved, long)
    assert dict(map(tuple, token_counts.counts(table, path).collect())) == {r[0]: len(exact.encode(r[1], add_special_tokens=False).ids) for r in rows}
    monkeypatch.setattr(token_counts, "WINDOW", 3)  # as good as every place begins a window
    short = [x[:40] for x in long] + mixed_texts(5)
    assert token_counts.Counter(pieces).texts(pa.array(short)).tolist() == [len(exact.encode(x, add_special_tokens=False).ids) for x in short]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    w, hit, found = item_words(text), set(), set()
    for item, body in items:
        own = item_words(body)
        m = min(10, len(own))
        for j in range(len(own) - m + 1 if own else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == own[j : j + m]:
                    hit |= set(range(i, i + m))
                    found.add(item)
    return len(w), len(hit), found - {None}


@pytest.mark.parametrize("block", [1_000_000, 8])
def test_decontamination(spark, saved, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_PHRASES", block)
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(12)]
    items = [(str(k), " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 10, 14])))) for k in range(8)]
    items += [("dup", items[3][1]), (None, items[4][1]), ("empty", None), ("punct", "!!! ???")]
    texts = [*EDGES, *(" ".join(rng.choices(vocab, k=rng.randint(0, 60))) + (". " + (rng.choice(items)[1] or "") + "! tail" if rng.random() < 0.7 else "") for _ in range(30))]
    table, rows = docs(saved, texts)
    bench = saved(items, "item_id string, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"]))) for r in decontamination.hits(table, bench).collect()), key=repr)
    want = []
    for r in rows:
        n, hit, found = brute_hits(r[1], items)
        want.append((r[0], n, hit, tuple(sorted(found))))
    assert got == sorted(want, key=repr)
    clash = table.withColumnsRenamed({"n_words": "Hits", "kept": "hits_"})
    cut = decontamination.cut(clash, bench)
    assert cut.columns == clash.columns
    left = {r.doc_id: r.text for r in cut.collect()}
    for r in rows:
        if r[0]:
            n, hit, _ = brute_hits(r[1], items)
            assert len(item_words(left[r[0]])) == n - hit
            assert hit or left[r[0]] == r[1]
    assert decontamination.hits(table, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.hits(table.limit(0), bench).count() == 0


def test_blocks_of_an_earlier_benchmark_are_forgotten(tmp_path, monkeypatch):
    from pyarrow import parquet

    monkeypatch.setattr(decontamination, "_held", {})
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        for k in range(6):
            path = tmp_path / folder / f"{k}.parquet"
            parquet.write_table(pa.table({"phrase": ["a b", "c", "a b"], "item": ["x", None, "y"]}), path)
            for _ in range(2):
                got = decontamination.block_at(f"file://{path}", 2)
                assert got.lengths.tolist() == [2, 1] and got.ids == ["x", None, "y"]
        assert sorted(p.split("/")[-2] for p in decontamination._held) == [folder] * decontamination.HELD


def test_decontamination_has_one_index_at_a_time(spark, saved, monkeypatch):
    alive, most = weakref.WeakSet(), []

    class Counted(decontamination.FMIndex):
        def __init__(self, *args):
            alive.add(self)
            most.append(len(alive))
            super().__init__(*args)

    table, _ = docs(saved, [f"w{k} a b c" for k in range(40)])
    bench = saved([("x", "a b c")], "item_id string, text string")
    tasks = []
    with monkeypatch.context() as m:  # the function of the task, to be run here
        m.setattr(type(table), "mapInArrow", lambda self, run, schema: tasks.append(run) or self.withColumn("hits", F.expr(f"CAST(null AS {decontamination.ADDED_SQL})")))
        decontamination.with_hits(table, bench)
    monkeypatch.setattr(decontamination, "FMIndex", Counted)
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 40)
    batch = pa.RecordBatch.from_pandas(table.toPandas())
    got = pa.Table.from_batches(list(tasks[0](iter([batch]))))
    assert got.num_rows == 42 and got.column("hits").combine_chunks().field("n_hit").to_pylist() == [3] * 42
    assert len(most) > 4 and max(most) == 1


def test_quality_method_verdict_with_production_limits():
    """Planted long repeats that the simple rules leave are rejected, by length and by share; clean texts stay."""
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    twice = lambda length, n: (lambda p: " ".join(p + fresh(n - 2 * length) + p))(fresh(length))
    many = [fresh(10) for _ in range(7)]
    texts = [twice(80, 1000), twice(400, 5000), twice(60, 20_000), " ".join(sum([[*p, *fresh(1)] for p in many * 2], []) + fresh(846))]
    clean = [" ".join(fresh(1000)), twice(9, 1000), twice(50, 1000)]
    m = quality_rules.measures(pa.array([*texts, *clean])).to_pydict()
    assert m["base_failed"] == [False] * 7 and m["kept"] == [False] * 4 + [True] * 3
    assert m["longest_repeat"] == [80, 400, 60, 10, m["longest_repeat"][4], 9, 50] and m["n_covered_words"][3] == 140


def luhn(d):
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_spans(spark, saved):
    rng = random.Random(7)
    alphabet = ["a", "B", "@", ".", "..", "-", "_", "1", "23", "255", "256", ".1.", "+", "+1", " ", "  ", "(", ")", "\x01", "\x02", "x@y.z", "é", "🙂", "4111 1111 1111 1111", "4111-1111-1111-1111", "10.0.0.1", "\n", "%", "+1 (988) 555-2485", "0"]
    texts = [*EDGES, "9" * 20_000 + ".1", "a." * 20_000 + "@", "a@" + "b." * 20_000 + "c", "1 " * 30_000, "+1" + "(" * 20_000]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(500)]
    table, rows = docs(saved, texts)
    got = sorted(((r.doc_id, [tuple(s) for s in r.base]) for r in pii.spans(table).collect()), key=repr)
    assert got == sorted(((r[0], brute_pii(r[1])) for r in rows), key=repr)
    assert pii.spans(table.limit(0)).count() == 0


def test_pii_learns_from_context(spark, saved):
    texts = [f"please contact me at user{k}@mail{k % 7}.example.com for more" for k in range(40)]
    texts += ["please contact me at john17(at)mail for more", "the year 123456 was good", "at noon 99999 people came"]
    table = saved(list(enumerate(texts)), "doc_id long, text string")
    added = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.added] for r in pii.spans(table).collect() if r.added}
    assert added == {40: [("context_email", "john17(at)mail")]}


def test_pii_patterns_come_in_by_found_instances(spark, saved):
    """A context without any seed is learned from instances that another context has found."""
    texts = [f"please contact me at user{k}@mail{k % 7}.example.com for more" for k in range(40)]
    texts += [f"please contact me at john{k}(at)mail for more" for k in range(6)]
    texts += [f"write us to: john{k}(at)mail today" for k in range(6)] + ["write us to: newone9(at)mail today", "the year 123456 was good"]
    table = saved(list(enumerate(texts)), "doc_id long, text string")
    added = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.added] for r in pii.spans(table).collect() if r.added}
    assert added == {40 + k: [("context_email", f"john{k % 6}(at)mail")] for k in range(12)} | {52: [("context_email", "newone9(at)mail")]}


def test_pii_secrets_by_their_context(spark, saved):
    """Hexadecimal seeds teach a key; other values of that key are found, hexadecimal strings elsewhere are left."""
    keys = [f"{k:x}".rjust(4, "b") * 10 for k in range(4096, 4136)]
    texts = [f'some words number{k} token = "{x}" and more words' for k, x in enumerate(keys)]
    texts += ['here is token = "ABC123-not-hex" too', f"a digest {keys[0][::-1]} in prose", "\n".join(f"mail{k}@example.com and" for k in range(3000))]
    table = saved(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(table).collect()}
    for k, x in enumerate([*keys, "ABC123-not-hex"]):
        assert [(s.kind, texts[k][s.start : s.end]) for s in got[k].added] == [("context_secret", x)]
    assert not got[41].added and [tuple(s) for s in got[42].base] == brute_pii(texts[42]) and len(got[42].base) == 3000


def test_pii_without_length_bounds(spark, saved):
    long = "x" * 300 + "1(at)mail"
    texts = [f"please contact me at user{k}@mail{k % 7}.example.com for more" for k in range(40)]
    texts += [f"please contact me at {long} for more", "host 1.00000000000002.3.4 is up", "(a" * 50_000 + " (" * 1000]
    table = saved(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(table).collect()}
    assert [texts[40][s.start : s.end] for s in got[40].added] == [long]
    assert [tuple(s) for s in got[41].base] == brute_pii(texts[41]) != [] and not got[42].added


def test_lm_gradient_and_scores():
    shape = lm_scoring.Shape(4, 5, 2, 3, 6)
    net = lm_scoring.Net(shape, np.random.default_rng(0).normal(0, 0.5, lm_scoring.Net(shape).flat.shape))
    rng = np.random.default_rng(1)
    context, target = rng.integers(0, 21, (7, 4)), rng.integers(0, 20, 7)
    grad = net.gradient(context, target)
    for k in rng.integers(0, len(net.flat), 30):
        old = net.flat[k]
        net.flat[k] = old + 1e-5
        up = -net.log_prob(context, target).mean()
        net.flat[k] = old - 1e-5
        down = -net.log_prob(context, target).mean()
        net.flat[k] = old
        assert abs((up - down) / 2e-5 - grad[k]) < 1e-5
    assert abs(sum(np.exp(net.log_prob(context[:1], np.array([k]))[0]) for k in range(20)) - 1) < 1e-9


def test_lm_scoring_meets_each_class_in_few_chunks(monkeypatch):
    """Products by class follow the classes and the chunks, and not their product; the scores are those of single positions."""
    shape = lm_scoring.Shape(8, 5, 2, 3, 6)
    words = pa.array([f"w{k}" for k in range(shape.words)], pa.large_binary())
    flat = np.random.default_rng(0).normal(0, 0.5, lm_scoring.Net(shape).flat.shape)
    model = lm_scoring.Model(shape, words, len(words), np.zeros(len(words)), np.zeros(shape.members), flat)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(60))) for _ in range(30)]
    by_class, products = lm_scoring.Net.by_class, []

    def counting(net, target):
        out = by_class(net, target)
        products.append(len(out[1]))
        return out

    monkeypatch.setattr(lm_scoring.Net, "by_class", counting)
    n, total = model.score(pa.array([*texts, ""]), chunk=16)
    assert sum(products) <= 2 * shape.classes + -(-n.sum() // 16)
    net = lm_scoring.Net(shape, flat)
    for k, t in enumerate(texts):
        own = [int(w[1:]) if int(w[1:]) < shape.words else shape.words + lm_scoring.bucket_of(*(np.array([x]) for x in (0, len(w))), np.frombuffer(w.encode(), np.uint8), shape.members)[0] for w in t.split()]
        pad = [40, 40, *own, 40, 40]
        assert n[k] == len(own) and abs(total[k] - sum(brute_log_prob(net, pad, 2 + j) for j in range(len(own)))) < 1e-9 * max(1, len(own))
    assert n[-1] == 0 and total[-1] == 0


def test_lm_logits_beyond_exponentials():
    """Logits whose exponentials would overflow or vanish get the common term off first."""
    shape = lm_scoring.Shape(4, 5, 2, 3, 6)
    rng = np.random.default_rng(5)
    small = rng.normal(0, 0.5, lm_scoring.Net(shape).flat.shape)
    context, target = rng.integers(0, 21, (50, 4)), rng.integers(0, 20, 50)
    for name, by in (("cb", 200), ("mb", 200), ("cb", -200), ("mb", -200), ("c", 400), ("m", 400)):
        net = lm_scoring.Net(shape, small.astype(np.float32))
        if by in (200, -200):  # the same for all: no probability changes
            want = net.log_prob(context, target), net.gradient(context, target)
            net.part[name][:] += by
            assert not net.bounded()
            assert np.allclose(net.log_prob(context, target), want[0], atol=1e-3) and np.allclose(net.gradient(context, target), want[1], atol=1e-4)
        else:
            net.part[name][:] *= by
            wide = lm_scoring.Net(shape, net.flat.astype(np.longdouble))
            want = [brute_log_prob(wide, [*c[:2], t, *c[2:]], 2) for c, t in zip(context, target)]
            assert not net.bounded() and np.allclose(net.log_prob(context, target), want, rtol=1e-3, atol=1e-2) and np.isfinite(net.gradient(context, target)).all()


def brute_model(texts, shape, room):
    """Tokens and charges of any word, by plain counting."""
    counts = collections.Counter(w for t in texts for w in words_of(t))
    step = {w: int(np.floor(np.log2(n) * lm_scoring.STEPS)) for w, n in counts.items()}
    least = min((s for s in step.values() if sum(x >= s for x in step.values()) <= room), default=1 << 30)
    known = sorted((w for w in counts if step[w] >= least), key=lambda w: (-counts[w], w.encode()))
    head = known[: shape.words]

    def bucket(w):
        b = w.encode()
        return (len(b) * 31 + b[0] * 7 + b[-1] * 131) % shape.members

    def token(w):
        if w in head:
            return head.index(w), 0.0
        mates = [x for x in counts if bucket(x) == bucket(w) and x not in head]
        rest = [x for x in mates if x not in known]
        total = sum(counts[x] for x in mates) + 1
        share = counts[w] / total if w in known else (sum(counts[x] for x in rest) + 1) / total / (len(rest) + 1)
        return shape.words + bucket(w), np.log(share)

    return token


def brute_log_prob(net, pad, at):
    """Of one token, from those around it, by loops over the parameters."""
    p, s = net.part, net.shape
    x = np.concatenate([p["vec"][pad[at + k]] for k in (-2, -1, 1, 2)])
    h = np.tanh(x @ p["w"] + p["b"])
    c, m = divmod(pad[at], s.members)
    both = 0.0
    for logits, own in ((h @ p["c"] + p["cb"], c), (h @ p["m"][c] + p["mb"][c], m)):
        both += logits[own] - np.log(np.exp(logits).sum())
    return both


@pytest.mark.parametrize("held", [1, 1 << 25])
def test_lm_counts_and_tokens(spark, saved, monkeypatch, held):
    """Counts are the same however often a task sends them; training and scoring see the same tokens."""
    monkeypatch.setattr(lm_scoring, "HELD", held)
    monkeypatch.setattr(tr, "slices", lambda batch, column, cut=tr.slices: cut(batch, column, 500))
    texts = [*mixed_texts(40, seed=12), *EDGES]
    table = saved(list(enumerate(texts)), "doc_id long, text string").select("text")
    got = {bytes(r.word).decode(): r.n for r in lm_scoring.counted(table).collect()}
    assert got == collections.Counter(w for t in texts for w in words_of(t))
    model = lm_scoring.vocabulary(table, lm_scoring.Shape(3, 4, 2, 3, 6))
    column = pa.array(texts, pa.string())
    tokens, first = model.tokens(column)
    same, charge, start = model.charged(column)
    assert model.head == 8 < len(model.words) and np.array_equal(tokens, same) and np.array_equal(first, start)
    token = brute_model(texts, model.shape, lm_scoring.ROOM)
    want = [token(w) for t in texts for w in words_of(t)[:50]]
    kept = np.concatenate([np.arange(a, min(a + 50, b)) for a, b in zip(first[:-1], first[1:])])
    assert tokens[kept].tolist() == [x for x, _ in want] and np.allclose(charge[kept], [c for _, c in want])


@pytest.mark.parametrize("room", [5, 1000])
def test_lm_against_brute_force(spark, saved, monkeypatch, room):
    """Vocabulary, charges and scores of every text, with few and with all words in the vocabulary."""
    monkeypatch.setattr(lm_scoring, "ROOM", room)
    texts = [*mixed_texts(40, seed=12), *EDGES]
    table = saved(list(enumerate(texts)), "doc_id long, text string")
    shape = lm_scoring.Shape(3, 4, 2, 3, 6)
    model = lm_scoring.fit(table, shape=shape, training=lm_scoring.Training(batch=64))
    room = max(room, int(2 * sum(len(words_of(t)) for t in texts) ** 0.5))
    token, net = brute_model(texts, shape, room), lm_scoring.Net(shape, model.flat.astype(np.float64))
    got = {r.doc_id: r for r in lm_scoring.scores(table, model).collect()}
    for k, t in enumerate(texts):
        own = [token(w) for w in words_of(t)[:400]]
        if len(own) == 400:
            continue
        pad = [12, 12, *(x for x, _ in own), 12, 12]
        want = sum(brute_log_prob(net, pad, 2 + j) + c for j, (_, c) in enumerate(own))
        assert got[k].n_tokens == len(own) and abs(got[k].log_prob - want) < 1e-3 * max(1, len(own))
    # all words and one more for each bucket divide the whole probability
    context = np.random.default_rng(3).integers(0, 13, (1, 4))
    every = {w for t in texts for w in words_of(t)}
    shares = collections.defaultdict(float)
    for w in every:
        shares[token(w)[0]] += np.exp(token(w)[1])
    total = sum(np.exp(net.log_prob(context, np.array([x]))[0]) * s for x, s in shares.items())
    assert total < 1 + 1e-6


def test_lm_learns(spark, saved):
    """Held-out text of the same kind is more likely than before training, and than shuffled text."""
    rng = random.Random(8)
    phrase = ["red", "fish", "swims", "under", "the", "old", "bridge", "at", "night"]
    texts = [" ".join(phrase[k % 9] for k in range(s, s + rng.randint(20, 60))) for s in rng.choices(range(9), k=800)]
    table = saved(list(enumerate(texts)), "doc_id long, text string")
    shape = lm_scoring.Shape(4, 8, 2, 8, 16)
    training = lm_scoring.Training(rounds=2, batch=64)
    model = lm_scoring.fit(table, shape=shape, training=training)
    new = lm_scoring.vocabulary(table, shape)
    held = " ".join(phrase * 5)
    words = held.split()
    rng.shuffle(words)
    mean = lambda m, t: (lambda n, s: s[0] / n[0])(*m.score(pa.array([t])))
    assert mean(model, held) > mean(new, held) + 1 and mean(model, held) > mean(model, " ".join(words)) + 0.5
    rows, all_rows = docs(saved, EDGES)
    got = lm_scoring.scores(rows, model).collect()
    assert len(got) == len(all_rows) and all((r.mean_log_prob is None) == (r.n_tokens == 0) for r in got)
    assert lm_scoring.scores(rows.limit(0), lm_scoring.fit(rows.limit(0), shape=shape)).count() == 0


def test_lm_trains_on_every_token(spark, saved):
    """The rounds take turns at the places: each of four words is a target, also in texts of two words."""
    shape = lm_scoring.Shape(4, 8, 2, 8, 16)
    for text in ("red fish", "a b c d"):
        table = saved([(k, text) for k in range(300)], "doc_id long, text string")
        start = lm_scoring.vocabulary(table, shape)
        before = lm_scoring.Net(shape, start.flat).part["mb"][0].copy()
        start.flat[:] = lm_scoring.Net(shape).flat
        before = lm_scoring.Net(shape, start.flat.copy()).part["mb"][0].copy()
        moved = [lm_scoring.Net(shape, lm_scoring.trained(table, start, lm_scoring.Training(rounds=2), k)).part["mb"][0] > before for k in range(2)]
        assert np.array(moved).any(axis=0)[: len(text.split())].all()


def test_lm_ranks_random_letters_below_prose(spark, sf_dir):
    rng = random.Random(4)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm_scoring.fit(documents)
    prose = sorted(r.mean_log_prob for r in lm_scoring.scores(documents, model).where("n_tokens BETWEEN 100 AND 400").collect())
    noise = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(200)) for _ in range(20)]
    n, total = model.score(pa.array(noise))
    assert (total / n).max() < prose[len(prose) // 20]


def test_crc_matches_spark(spark, saved):
    from pyspark.sql import functions as F

    table, _ = docs(saved, ["some words"])
    row = packing.pieces(table, P.path("byte_bpe_50k.json")).select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(bytes(row.ids))


def test_slices_cover_all_rows():
    batch = pa.record_batch({"text": pa.array(["a" * k for k in range(50)] + [None, ""]), "n": pa.array(range(52))})
    parts = list(tr.slices(batch.slice(3), "text", 100))
    assert [x for p in parts for x in p.column("n").to_pylist()] == list(range(3, 52))
