"""Operators that relate rows to each other, against plain Python."""

import base64
import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, graph, jaccard_join, line_dedup, packing, quality_rules, queries, shared, url_filters, warc

SCHEMA = "doc_id long, text string, row string, uid int, label int, key string"
EDGES = [None, "", "\n\n", " ", "one", "one two", "\n one \n\n two"]


def table(saved, texts, parts=2):
    rows = [(k, t, "x", 1, 2, "k") for k, t in enumerate(texts)]
    return saved(rows, SCHEMA, parts), rows


def brute_runs(seqs):
    """(d, i): longest run of lines from there that occurs at an earlier place too, and the first such place."""
    places = [(d, i) for d, s in enumerate(seqs) for i in range(len(s))]
    out = {}
    for n, (d, i) in enumerate(places):
        best = (0, None)
        for e, j in places[:n]:
            k = 0
            while i + k < len(seqs[d]) and j + k < len(seqs[e]) and seqs[d][i + k] == seqs[e][j + k]:
                k += 1
            if k > best[0]:
                best = (k, (e, j))
        out[d, i] = best
    return out


def brute_dedup(rows, min_lines=3, min_chars=60):
    """Rows in the order of id: the text of each without later copies of runs, found by comparing all places."""
    numbers, seqs = [], []
    for r in rows:
        lines = [] if r[1] is None else r[1].split("\n")
        own = [(k, x) for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        numbers.append([k for k, _ in own])
        seqs.append([x for _, x in own])
    gone = collections.defaultdict(set)
    for (d, i), (n, first) in brute_runs(seqs).items():
        if n and len(seqs[d][i]) >= min_chars:
            gone[d].add(numbers[d][i])
        if n >= min_lines:
            spared = range(first[1], first[1] + min_lines) if first[0] == d else ()
            gone[d] |= {numbers[d][j] for j in range(i, i + n) if j not in spared}
    return [None if r[1] is None else "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone[d]) for d, r in enumerate(rows)], [len(gone[d]) for d in range(len(rows))]


def test_line_dedup_keeps_a_first_copy_of_runs_that_overlap(spark, saved):
    texts = ["\n".join("aaaaa"), "\n".join("xyxyxy"), "\n".join("b" * 100), "q\n" + "\n".join("aaaa"), "\n".join("abcdefgh"), "\n".join("bcdefg")]
    docs, rows = table(saved, texts)
    got = [r.text for r in line_dedup.dedup(docs).orderBy("doc_id").collect()]
    assert got == ["a\na\na", "x\ny\nx", "b\nb\nb", "q", "\n".join("abcdefgh"), ""] and got == brute_dedup(rows)[0]
    runs = {(r.doc_id, r.line): (r.n_lines, r.first_id, r.first_line) for r in line_dedup.runs(docs).collect()}
    assert runs[5, 0] == (6, 4, 1) and runs[0, 1] == (4, 0, 0) and (5, 1) not in runs and runs[2, 1] == (99, 2, 0)


@pytest.mark.parametrize("min_lines", [2, 3, 5])
def test_line_dedup(spark, saved, min_lines):
    rng = random.Random(min_lines)
    vocab = [f"line {k}" for k in range(6)] + ["long " * 13 + str(k) for k in range(3)] + ["", "  "]
    texts = [*EDGES, *("\n".join(rng.choices(vocab, k=rng.randint(0, 12))) for _ in range(40))]
    texts += [texts[20], *("\n".join(t.split("\n")[a:]) for t in texts[15:25] for a in (0, 1, 3)), "\n".join(rng.choices("ab", k=40))]
    docs, rows = table(saved, texts)
    want, n = brute_dedup(rows, min_lines)
    found = brute_runs([[x for x in (r[1] or "").split("\n") if x.strip()] for r in rows])
    for r in line_dedup.runs(docs, min_lines=min_lines).collect() if min_lines == 3 else []:
        assert found[r.doc_id, r.line] == (r.n_lines, (r.first_id, r.first_line))
    marked = line_dedup.marked(docs, min_lines=min_lines).select("row.doc_id", "n_deleted", "n_lines", "rest").orderBy("doc_id").collect()
    assert [r.rest for r in marked] == want
    assert [r.n_deleted for r in marked] == n and [r.n_lines for r in marked] == [len(r[1].split("\n")) if r[1] is not None else 0 for r in rows]
    none = line_dedup.dedup(docs.limit(0), min_lines=min_lines)
    assert none.count() == 0 and none.columns == docs.columns


def test_line_dedup_with_repeated_and_null_ids(spark, saved):
    passage = "a passage of many words that is long enough to count on its own here"
    docs = saved([(None, passage, "", 0, 0, ""), (5, passage, "", 0, 0, ""), (5, passage, "", 0, 0, ""), (7, passage, "", 0, 0, "")], SCHEMA, 1)
    done = line_dedup.dedup(docs).orderBy("doc_id", F.desc("text")).collect()
    assert [(r.doc_id, r.text) for r in done] == [(None, ""), (5, passage), (5, ""), (7, "")]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return [(r[0], len(s), rows[find(k)][0]) for k, (r, s) in enumerate(zip(rows, sets))]


def near_copies(seed, groups=6, size=12):
    """Groups of copies with edits around the threshold, and a passage that many share."""
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocab, k=40))
    texts = []
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.choice([4, 8, 60, 150]))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            text = " ".join(own)
            if rng.random() < 0.2:
                text += " " + passage
            texts.append(text.upper() if rng.random() < 0.2 else text)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, saved, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "SHINGLES", 100)
    monkeypatch.setattr(jaccard_join, "PER_LEADER", 2)
    docs, rows = table(saved, [*EDGES, "One", *near_copies(seed)])
    got = sorted(tuple(r) for r in jaccard_join.joined(docs).collect())
    want = brute_components(rows)
    assert got == sorted(want)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, n, c in want if c == d)


def test_jaccard_join_without_rows_and_with_repeated_ids(spark, saved):
    docs = saved([(3, "a b c d e f", "", 0, 0, ""), (3, "q r s t u v", "", 0, 0, ""), (None, "a b c d e f", "", 0, 0, ""), (None, None, "", 0, 0, "")], SCHEMA)
    assert sorted(map(tuple, jaccard_join.joined(docs).collect()), key=repr) == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3), (None, 0, None)], key=repr)
    assert sorted(r.text or "" for r in jaccard_join.one_of_each(docs).collect()) == ["", "a b c d e f", "q r s t u v"]
    assert jaccard_join.joined(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_summed_blocks(spark):
    import numpy as np

    rows = [(k % 3, np.full(4, k, np.int64).tobytes()) for k in range(30)]
    got = shared.joined_blocks(shared.summed(spark.createDataFrame(rows, "block int, data binary").repartition(5), "i8"), "i8")
    assert got.reshape(3, 4)[:, 0].tolist() == [sum(range(b, 30, 3)) for b in range(3)]


PAGES = "page_id long, url string, html string, sha string, revisit string"


def test_warc_round_trip(spark, saved):
    rng = random.Random(9)
    same = "<p>same</p>" * 50
    nested = "".join(chr(b) for b in warc.member(warc.record("response", "77", "http://inner/", b"inner " * 20, warc.digest_of(b"inner " * 20), None)))
    noise = "".join(chr(rng.randrange(256)) for _ in range(30_000))
    html = [None, "", same, same, "é漢🙂", noise, nested, noise + nested + "x", "b" * 100_000, same, "\x1f\x8b\x08 WARC/1.1\r\nWARC-Type: response"]
    rows = [(k, f"http://h/{k} \r\nEvil: 1", h, "clash", "clash") for k, h in enumerate(html)] + [(None, None, same, "", ""), (2, "u", same, "", "")]
    pages = saved(rows, PAGES, 2)
    folder = shared.fresh(spark, "warc")
    archives = warc.write(pages, folder)
    for split in (1 << 20, 5_000, 700):
        got = warc.read(archives, folder, split).collect()
        best = {}
        for r in rows:
            p = r[2] or ""
            best[p] = min(best.get(p, (True, 0)), (r[0] is None, r[0] or 0))
        want, seen = [], set()
        for r in rows:
            p = (r[2] or "").encode()
            first = best[r[2] or ""] == (r[0] is None, r[0] or 0) and p not in seen
            if first:
                seen.add(p)
            want.append((r[0], len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first else "revisit", None if first else best[r[2] or ""][1]))
        assert sorted(((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
        assert {bytes(r.payload) for r in got if r.record_type == "response"} == {(r[2] or "").encode() for r in rows}
    assert warc.read(warc.write(pages.limit(0), shared.fresh(spark, "none")), folder).count() == 0


class Source:
    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        got = self.data[self.at : self.at + n]
        self.at += len(got)
        return got


def test_warc_reader_skips_what_is_stored_inside_a_payload():
    """A member that lies in the file as it is, inside a stored block, belongs to the outer record."""
    inner = b"".join(warc.member(warc.record("response", str(k), "u", b"in", warc.digest_of(b"in"), None)) for k in range(900, 905))
    outer = warc.record("response", "1", "u", inner, warc.digest_of(inner), None)
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = c.compress(outer) + c.flush()
    assert inner in stored
    plain = [warc.member(warc.record("response", str(k), "u", bytes([k]) * 3000, "", None)) for k in range(2, 9)]
    data = b"".join([plain[0], stored, *plain[1:]])
    for split in (37, 101, 1000, 10_000_000):
        found = []
        for start in range(0, len(data), split):
            found += [f["warc-record-id"] for _, f, _ in warc.owned(Source(data), len(data), start, min(start + split, len(data))) if f]
        assert found == [f"<urn:x-page:{k}>" for k in [2, 1, *range(3, 9)]]
    broken = bytearray(data)
    broken[len(data) - 20] ^= 255  # the last record is damaged, the others stay
    assert [f["warc-record-id"] for _, f, _ in warc.owned(Source(bytes(broken)), len(data), 0, len(data)) if f] == [f"<urn:x-page:{k}>" for k in [2, 1, *range(3, 8)]]


def test_warc_of_another_writer(spark, tmp_path):
    """Field names in any case, other record ids, no digest, a revisit without length; damaged records are told on demand."""
    head = "WARC/1.0\r\nwarc-type: {}\r\nWARC-RECORD-ID: <urn:uuid:{}>\r\nwarc-refers-to: <urn:uuid:1>\r\nCONTENT-length: {}\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    one = lambda kind, k: warc.member(head.format(kind, k, len(block)).encode() + block + b"\r\n\r\n")
    wrong = warc.member(warc.record("response", "9", "u", b"text", "A" * 32, None))
    cut = bytearray(one("response", 3) * 2)
    cut[len(cut) - 12] ^= 255
    data = one("response", 1) + wrong + one("revisit", 2) + bytes(cut)
    (tmp_path / "a.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(str(tmp_path / "a.warc.gz"), len(data))], "path string, size long")
    got = {(r.record_type, r.record_id, r.refers_to_id, r.payload_bytes) for r in warc.read(archives, f"file://{tmp_path}").collect()}
    first = "<urn:uuid:1>"
    assert got == {("response", first, first, 4), ("revisit", "<urn:uuid:2>", first, None), ("response", "<urn:uuid:3>", first, 4)}
    assert warc.read(archives, f"file://{tmp_path}", damaged=True).where("record_type = 'damaged'").count() == 2


def test_url_filters_with_doubled_slashes(spark):
    """Empty segments don't count, whatever the depth of the list is."""
    e = spark.sql("SELECT 'l' AS list, 'prefix' AS kind, 'h.com/a' AS key, 'block' AS action, DATE'2024-01-01' AS day UNION ALL SELECT 'l', 'host', 'h.com', 'allow', DATE'2024-01-01'")
    urls = ["http://h.com//a/x", "http://h.com/a//x", "http://h.com///a", "http://h.com//b/a", "http://h.com//"]
    c = spark.createDataFrame(list(enumerate(urls)), "id int, url string").selectExpr("*", "DATE'2024-01-02' AS fetched")
    deep = e.union(spark.sql("SELECT 'l', 'prefix', 'other.com/a/b/c', 'block', DATE'2024-01-01'"))
    for entries in (e, deep):
        assert [r.verdict for r in url_filters.decide(c, entries).orderBy("row.id").collect()] == ["block"] * 3 + ["allow"] * 2


def test_url_filters(spark):
    day = "CAST('2024-01-{:02d}' AS DATE)".format
    entries = [
        ("l", "domain", "bad.com", "block", 5), ("l", "domain", "bad.com", "remove", 10), ("l", "domain", "bad.com", "block", 20), ("l", "host", "ok.bad.com", "allow", 1),
        ("l", "prefix", "ok.bad.com/x/", "block", 7), ("m", "domain", "bad.com", "allow", 5), ("l", "host", "tie.com", "remove", 3), ("l", "host", "tie.com", "allow", 3), ("l", "host", "TIE.com", "block", 3),
        (None, "host", None, "block", 1), ("l", "host", "x.com", "odd", 1), ("l", "odd", "x.com", "block", 1),
    ]
    captures = [
        (1, "http://bad.com/", 4, "none"), (2, "http://a.b.BAD.com:80/x?y", 5, "block"), (3, "https://u:p@bad.com./", 10, "allow"), (4, "http://bad.com", 20, "block"), (5, "http://ok.bad.com/y", 6, "allow"),
        (6, "http://ok.bad.com/x/y/z#f", 7, "block"), (7, "http://ok.bad.com/xy", 9, "allow"), (8, "http://tie.com/", 3, "block"), (9, None, 9, "none"), (10, "nonsense", 9, "none"), (11, "http://x.com/", 9, "none"),
        (12, "http://notbad.com/", 9, "none"), (13, "http://bad.com/", None, "none"), (14, "http://" + "a." * 200 + "bad.com/", 6, "block"), (15, "http://u@v@tie.com/", 3, "block"), (16, "http://u@tie.com@x.com/", 3, "none"), (2, "http://a.b.BAD.com:80/x?y", 5, "block"),
    ]
    e = spark.createDataFrame(entries, "list string, kind string, key string, action string, d int").selectExpr("list", "kind", "key", "action", "date_add(DATE'2023-12-31', d) AS day")
    c = spark.createDataFrame(captures, "id int, url string, d int, verdict string").selectExpr("id", "url", "date_add(DATE'2023-12-31', d) AS fetched", "verdict AS best", "'clash' AS uid", "'clash' AS row")
    got = url_filters.decide(c, e).selectExpr("row.id", "row.best AS want", "verdict").collect()
    assert len(got) == len(captures) and all(r.want == r.verdict for r in got), got
    assert sorted(r.id for r in url_filters.keep(c, e).collect()) == sorted(k for k, *_, v in captures if v != "block")
    assert url_filters.keep(c, e).columns == c.columns
    assert url_filters.decide(c.limit(0), e).count() == 0 and url_filters.decide(c, e.limit(0)).where("verdict <> 'none'").count() == 0
    assert day(1)


def test_pipeline_against_brute_force(spark, sf_dir, saved):
    """run() on a sample of its kind: quality, dedup, components, removal and pieces, each done plainly."""
    pipeline = pytest.importorskip("corpus_pipeline")
    import shutil

    from tokenizers import Tokenizer

    rng = random.Random(10)
    vocab = [f"wo{k}" for k in range(3000)]
    sent = lambda n: " ".join(rng.choices(vocab, k=n))
    bench = [("0", sent(20)), ("1", sent(14)), ("2", sent(4))]
    header = sent(15)
    texts = [sent(40) + "\n" + sent(30) for _ in range(12)]
    texts += [header + "\n" + sent(50), header + "\n" + sent(50), texts[0], texts[1].replace("wo1", "wo2", 1), "short one", None, (sent(12) + "\n") * 4]
    texts += [sent(30) + " " + bench[0][1] + " " + sent(30), sent(40) + " " + bench[1][1], bench[0][1], " ".join(texts[2].split()[:69] + ["x"])]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    path = shared.plain_uri(shared.fresh(spark, "tables")).removeprefix("file://")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    got = collections.defaultdict(list)
    for r in pipeline.run(spark, path).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    shutil.rmtree(path)

    from tests.llm.test_rows import brute_quality, item_words  # noqa: F401

    own = [(d, t) for d, t, *_ in rows if brute_quality(t)[-1]]
    own = [(d, t) for (d, _), t in zip(own, brute_dedup(own)[0]) if t.strip()]
    own = [x for x, c in zip(own, brute_components(own)) if c[0] == c[2]]
    tok = Tokenizer.from_file(queries.tokenizer_path(queries.TOKENIZER))
    want = {}
    for d, t in own:
        spans = [m.span() for _, b in bench for m in re.finditer(re.escape(b), t)]
        for a, b in sorted(spans, reverse=True):
            t = t[:a] + "\n" + t[b:]
        if t.strip():
            ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
            at, pieces = 0, []
            for size in packing.decompose(__import__("numpy").array([len(ids)]))[0].tolist():
                pieces.append((at, size, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + size])), len(ids)))
                at += size
            want[d] = pieces
    assert {d: sorted(p) for d, p in got.items()} == want
    assert {16, 17}.isdisjoint(got) and 14 not in got and 21 not in got
    assert quality_rules and decontamination


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        done = stage(spark, docs, sf_dir)
        assert done.columns == docs.columns and [t for _, t in done.dtypes] == [t for _, t in docs.dtypes], name
        docs = shared.stored(done, "stage")
    assert docs.count() > 50
