"""Each operator against brute force on a small table with the awkward cases in it."""

import collections
import hashlib
import json
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import common, decontaminate, exact_dedup, line_dedup, lm_score, near_dedup, packing, pii, suffix_dedup, token_counts, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, row long, part string, key string"
BASE = " ".join(f"word{k} is{k % 7} here" for k in range(60))
PASSAGE = "this very passage is shared by several documents and has more than fifty bytes in it"
BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short One here"), (3, None), (4, ""), (None, "nobody knows what this item is called at all today ok")]
TEXTS = [
    BASE,
    BASE,
    BASE.replace("word3 ", "other "),
    BASE.replace("word3 ", "third "),
    BASE.replace("\x20", "\x20\x20", 3),
    None,
    "",
    "  \n\t ",
    "one two three",
    "ONE two three",
    "x" * 70_000,
    "x" * 300,
    f"begin {PASSAGE} end",
    f"other start {PASSAGE}",
    f"{PASSAGE} and {PASSAGE}",
    "é" * 40 + " ünï " + "ß" * 40,
    "é" * 40 + " ünï " + "ß" * 40 + " more",
    "see alpha BETA gamma, delta epsilon zeta eta theta iota kappa lambda and short one here",
    "Mail joe.doe@mail.example.com or 10.0.0.1, 300.1.1.1; card 4111 1111 1111 1111 call +1 (555) 123-4567.",
    "a@b a@b.c@d.e @x.y 1.2.3.4.5.6.7.8 +12345678 0000000000000 12-34",
    "first line\nsecond line\nthird line\nfirst line\nsecond line",
    "zero\nfirst line\nsecond line\nlast",
    "<|endoftext|> it's won't 12 34.5,, a.b É x\x1cy 日本語 ok! don't!!!",
]


def rows():
    out = [(k * 3 % 101 + 10, t) for k, t in enumerate(TEXTS)]
    out += [(out[3][0], "a text under an id that is taken already"), (None, BASE), (None, "nobody"), out[9], (5000, BASE)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", k, "p", "q") for k, (i, t) in enumerate(rows())], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def doubled_sum(digits):
    """Luhn's check by its table: every second digit from the right doubled, nines cast out."""
    return sum(int("0246813579"[int(c)]) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pii_base(docs, nothing):
    finders = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    want = collections.Counter()
    for i, t in rows():
        out = []
        for kind, f in zip(pii.KINDS, finders):
            for m in re.finditer(f, t or ""):
                d = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and doubled_sum(d), "phone": 9 <= len(d) <= 15}[kind]
                out += [f"{kind}:{m.start()}:{m.end()}"] if ok else []
        want[i, *(sum(x.startswith(k) for x in out) for k in pii.KINDS), hashlib.sha256(",".join(out).encode()).hexdigest(), ",".join(out)] += 1
    assert sum(n for k, n in want.items() if all(k[1:5])) >= 1
    found = pii.personal_data(docs)
    assert bag(found, "doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256", "spans") == want
    assert bag(found, "doc_id", "n_base") == collections.Counter((i, sum(n)) for i, *n, _, _ in want.elements())
    assert pii.personal_data(nothing).count() == 0


def test_pii_sanitises_every_row(spark, nothing):
    text = "Mail joe.doe@mail.example.com or 10.0.0.1"
    told = [(1, text, "a", "b"), (1, text, "a", "b"), (1, "another text", "c", None), (None, "see 10.0.0.1", "d", ""), (None, None, None, None)]
    df = spark.createDataFrame(told, "doc_id long, text string, span_key string, Found_Spans string")
    got = pii.sanitised(df)
    assert got.columns == df.columns
    want = [(i, t and t.replace("joe.doe@mail.example.com", "[email]").replace("10.0.0.1", "[ip]"), a, b) for i, t, a, b in told]
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(want)
    assert pii.sanitised(nothing).count() == 0


def test_pii_terms(spark):
    told = [(k, f"write to Gandalf at wizard@shire.example.org about thing{k}") for k in range(4)] + [(10 + k, f"about thing{k} and at nothing, write home to see") for k in range(30)]
    df = spark.createDataFrame(told, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert got[0] == "email:20:44,term:9:16" and got[10] == ""
    texts = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "wizard" not in texts[0] and "Gandalf" not in texts[0] and texts[11] == told[5][1]


def test_pii_counts_documents(spark):
    told = [(k, f"dear Gandalf of the hill wizard@shire.example.org a{'bcdefghijk'[k]}a went off by night") for k in range(10)]
    told += [(50, "Bilbo saw frodo@shire.example.org then Bilbo saw frodo@shire.example.org then Bilbo saw frodo@shire.example.org")]
    told += [(100 + k, "nothing at all of it here") for k in range(9)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    assert all(",term:5:12" in got[k].spans for k in range(10))  # the entity is in half of the documents
    assert got[50].n_terms == 0  # three mentions are one document


def test_pii_terms_as_they_are_written(spark):
    names = ["O'Neil", "J.R.Smith", "Éowyn", "host.shire", "ΟΔΟΣ"]
    told = [(10 * n + k, f"from ({name}), wizard{n}@shire.example.org") for n, name in enumerate(names) for k in range(3)]
    told += [(100 + k, f"from nothing here {k}") for k in range(60)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    assert all(got[10 * n].endswith(f",term:6:{6 + len(name)}") for n, name in enumerate(names))


def test_pii_terms_go_everywhere(spark):
    far = " ".join(["nothing"] * 40)
    told = [(k, f"to Gandalf user4711x wizard@shire.example.org {far} Gandalf") for k in range(10)]
    told += [(50, f"{far} user4711x, and Gandalf!")] + [(100 + k, "to nothing here") for k in range(190)]
    df = spark.createDataFrame(told, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for k in (0, 50):
        assert [told[k if k == 0 else 10][1][x.start : x.stop] for x in got[k].terms] == (["Gandalf", "user4711x", "Gandalf"] if k == 0 else ["user4711x", "Gandalf"])
    assert not any("Gandalf" in r.text or "4711" in r.text for r in pii.sanitised(df).collect())


def test_line_dedup(docs, nothing):
    got = collections.Counter({(r.doc_id, r.text): 1 for r in line_dedup.deduplicated(docs).filter("doc_id IS NOT NULL").collect()})
    ids = [i for i, t in rows() if t and t.startswith("first line")]
    after = [i for i, t in rows() if t and t.startswith("zero")]
    first, second = sorted([ids[0], after[0]])
    texts = dict(rows())
    assert (ids[0], "first line\nsecond line\nthird line" if first == ids[0] else "third line") in got
    assert (after[0], "zero\nlast" if first == ids[0] else texts[after[0]]) in got
    assert line_dedup.deduplicated(nothing).count() == 0


def test_line_runs_of_one_long_line(spark):
    long = "a line of a hundred characters or more " * 3
    df = spark.createDataFrame([(2, f"x\n{long}\ny"), (1, long), (3, long[:-1]), (4, long[:99]), (5, long[:99]), (None, long)], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_removed, r.n_runs, r.longest_run) for r in line_dedup.deduplicated(df).collect()} == {1: (long, 0, 0, 0), 2: ("x\ny", 1, 1, 1), 3: (long[:-1], 0, 0, 0), 4: (long[:99], 0, 0, 0), 5: (long[:99], 0, 0, 0), None: ("", 1, 1, 1)}


def test_line_dedup_by_brute_force(spark):
    r = np.random.default_rng(4)
    texts = [(k, "\n".join(r.choice(list("abc"), int(r.integers(1, 40))))) for k in range(30)] + [(40 + k, "\n".join(f"l{m}" for m in range(k * 9, 70))) for k in range(5)]
    seen, want = set(), {}
    for i, t in texts:
        lines, gone = t.split("\n"), set()
        for n in range(len(lines) - 1):
            gone |= {n, n + 1} if (lines[n], lines[n + 1]) in seen else set()
            seen.add((lines[n], lines[n + 1]))
        want[i] = "\n".join(x for n, x in enumerate(lines) if n not in gone)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(df).collect()} == want


def test_line_runs_are_maximal(spark):
    lines = [f"l{m}" for m in range(37)]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["x", *lines[3:30], "y", *lines[10:12]])), (3, "\n".join(lines[5:37]))], "doc_id long, text string").coalesce(1)
    got = line_dedup.repeated_runs(df).collect()
    rows_ = {r.row: r.doc_id for r in got}
    first = {r.first_row for r in got} - rows_.keys()
    assert len(first) == 1 and {(r.doc_id, r.start, r.lines, r.first_start) for r in got} == {(2, 1, 27, 3), (2, 29, 2, 10), (3, 0, 32, 5)}


def test_line_runs_of_three(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "a\nb\ny"), (4, "b\nc\nd")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.deduplicated(df, 3).collect()}
    assert got == {1: "a\nb\nc\nd", 2: "x", 3: "a\nb\ny", 4: ""}


def test_packing(docs, nothing):
    t = tokens.Tokenizer.from_file(common.vocabulary_path(tokens.VOCABULARY))
    pieces = sorted(packing.packed(docs, 64, keep_ids=True).collect(), key=lambda r: r.sequence_id * 64 + r.offset)
    at, found, held = 0, collections.Counter(), []
    for r in pieces:
        assert r.sequence_id * 64 + r.offset == at and 0 < r.length == len(r.ids) // 4 and r.offset + r.length <= 64
        assert zlib.crc32(r.ids) == r.ids_crc32 and r.start == len(held)
        held += np.frombuffer(r.ids, "<u4").tolist()
        at += r.length
        if len(held) == r.doc_tokens:
            found[r.doc_id, *held] += 1
            held = []
    assert not held
    assert found == collections.Counter((i, *t.encode(x or "", add_special_tokens=False).ids, 2) for i, x in rows())
    assert bag(packing.packed(docs, 64), "doc_id", "doc_tokens", "length").total() == len(pieces)
    assert packing.packed(nothing).count() == 0


def test_vocabulary_allows_both_mergers():
    path = common.vocabulary_path(tokens.VOCABULARY)
    with open(path) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    t = tokens.Tokenizer.from_file(path)
    for token, i in vocabulary.items():
        if token.endswith(tokens.END):
            assert [x.id for x in t.model.tokenize(token.removesuffix(tokens.END))] == [i]


def test_token_counts(docs, nothing, spark, tmp_path):
    t = tokens.Tokenizer.from_file(common.vocabulary_path(tokens.VOCABULARY))
    t.encode_special_tokens = True
    want = collections.Counter((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows())
    assert bag(token_counts.token_counts(docs), "doc_id", "n_tokens") == want
    small = token_counts.flat_blocks(docs, block=7)
    counted = token_counts.scan(small.filter("ids IS NOT NULL"))
    assert collections.Counter(r.n_tokens for r in counted.collect()) == collections.Counter(n for (_, n), m in want.items() for _ in range(m))
    assert token_counts.token_counts(nothing).count() == 0
    np.array([5, 6, 9, 9, 7, 9, 1, 2], "<u4").tofile(tmp_path / "a.bin")
    blocks = token_counts.read_flat(spark, str(tmp_path / "a.bin"), 4, 3)
    assert [r.n_tokens for r in token_counts.scan(blocks, 9, 4).orderBy("document").collect()] == [2, 0, 1]
    assert [r.n_tokens for r in token_counts.open_tails(blocks, 9, 4).collect()] == [2]


@pytest.mark.parametrize("group", [1, 3, 1024])
def test_flat_files_by_ranges(spark, tmp_path, monkeypatch, group):
    monkeypatch.setattr(token_counts, "GROUP", group)
    r = np.random.default_rng(7)
    want, tails = collections.Counter(), {}
    for name, n in {"a b.bin": 400, "c.bin": 61, "none.bin": 0, "open.bin": 30}.items():
        ids = r.integers(0, 3 if name != "open.bin" else 2, n).astype("<u2")
        (tmp_path / name).write_bytes(ids.tobytes() + b"\1" * (name == "c.bin"))  # a byte that is no whole id
        runs = "".join(map(str, ids)).split("2")
        want.update((name, k, len(x)) for k, x in enumerate(runs[:-1]))
        tails |= {name: len(runs[-1])} if runs[-1] else {}
    blocks = token_counts.read_flat(spark, str(tmp_path), 2, 8)
    got = collections.Counter((r.file.rsplit("/", 1)[1], r.document, r.n_tokens) for r in token_counts.scan(blocks, 2).collect())
    assert got == want and len(want) > 100
    assert {r.file.rsplit("/", 1)[1]: r.n_tokens for r in token_counts.open_tails(blocks, 2).collect()} == tails


def test_suffix_dedup(docs, nothing):
    top = 1 << 62
    raw = [(top if i is None else i, (t or "").encode()) for i, t in rows()]
    least = {}
    for i, b in raw:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            least[w] = min(least.get(w, i), i)
    want = collections.Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[None if i == top else i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()] += 1
    assert bag(suffix_dedup.repeated_passages(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_dedup.repeated_passages(nothing).count() == 0


def test_longest_previous_factors():
    r = np.random.default_rng(0)
    for trial in range(60):
        strings = [bytes(r.integers(97, 99, int(r.integers(3, 20))).astype(np.uint8)) for _ in range(int(r.integers(1, 60)))]
        strings = [x[:2] + b"\0" * int(r.integers(0, 4)) + x[2:] if trial % 3 == 0 else x for x in strings]
        doc = r.integers(0, 8, len(strings))
        width = -(-max(map(len, strings)) // 8)
        words = [np.array([int.from_bytes(x.ljust(8 * width, b"\0")[8 * k : 8 * k + 8], "big") for x in strings], np.uint64) for k in range(width)]
        got = suffix_dedup.factors(words, np.array([len(x) for x in strings]), doc, 2)
        common_ = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        want = [max((common_(x, y) for y, e in zip(strings, doc) if e < d), default=0) for x, d in zip(strings, doc)]
        assert got.tolist() == [w if w >= 2 else 0 for w in want]


def test_suffix_segments_are_told_apart_by_all_bits(monkeypatch):
    plain = suffix_dedup.segments

    def clashing(buf, off):
        doc, first, last, least, whole = plain(buf, off)
        return doc, first, last, least, whole & np.uint64(0xFFFFFFFF)  # the upper halves clash

    monkeypatch.setattr(suffix_dedup, "segments", clashing)
    shared = "one passage of twenty bytes and some more"
    texts = [f"{chr(97 + k) * 45}{shared}{chr(107 + k) * 45}" for k in range(4)] + [f"{'a' * 45}{shared}{'k' * 45}"]
    table = pa.table({"doc_id": pa.array(range(5), pa.int64()), "text": texts, "chunk": pa.array([0] * 5, pa.int32())})
    chunk = suffix_dedup.Chunk(table, 1)
    strings = [bytes(chunk.buf[a : b + suffix_dedup.LEAST]) for a, b in zip(chunk.first, chunk.last)]
    assert len(chunk.records) == len(set(strings))
    parts = [table.slice(k, 1).set_column(2, "chunk", pa.array([k], pa.int32())) for k in range(5)]
    told = suffix_dedup.resolve_hashes(pa.concat_tables([suffix_dedup.send_hashes(1)(x) for x in parts])).to_pylist()
    for k, part in enumerate(parts):
        c = suffix_dedup.Chunk(part, 1)
        whole = c.told(pa.Table.from_pylist([r for r in told if r["chunk"] == k], suffix_dedup.TOLD_SCHEMA))[0]
        assert whole.all() if k == 4 else not whole.any()


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(pairs):
    """Of each of the (identifier, set) pairs the smallest identifier that links lead to."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, s) in enumerate(pairs):
        for j, (_, u) in enumerate(pairs[:k]):
            if s and u and 4 * min(len(s), len(u)) >= 3 * max(len(s), len(u)) and 100 * len(s & u) >= 75 * len(s | u):
                root[find(j)] = find(k)
    least = {}
    for k, (i, _) in enumerate(pairs):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(pairs))]


def test_near_dedup(docs, nothing):
    sets = [(i, shingle_set(t)) for i, t in rows()]
    real = [x for x in sets if x[0] is not None]
    of = list(zip(real, brute_components(real)))
    want = collections.Counter((i, len(s), c, c == i) for (i, s), c in of)
    want.update((i, len(s), None, True) for i, s in sets if i is None)
    assert bag(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == want
    assert near_dedup.near_duplicates(nothing).count() == 0
    odd = docs.withColumnsRenamed({"part": "gone_id", "key": "__id"})
    left, kept = near_dedup.drop_near_duplicates(odd), {i for (i, _), c in of if i == c} | {None}
    assert left.columns == odd.columns and bag(left, "doc_id", "text") == collections.Counter((i, t) for i, t in rows() if i in kept)


def test_near_dedup_finds_every_link(spark):
    """Recall over a whole small table: components against all pairs."""
    docs = common.load(spark, "/root/testdata/sf0.01", "documents")
    pairs = [(r.doc_id, shingle_set(r.text)) for r in docs.collect()]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    want = dict(zip([i for i, _ in pairs], brute_components(pairs)))
    assert got == want and sum(i != c for i, c in want.items()) > 50


def test_near_dedup_of_chains(spark):
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in r.integers(0, 10**6, 400)]
    texts, now = [], list(words)
    for k in range(40):  # neighbours are alike, ends aren't
        texts.append((k, " ".join(now)))
        for p in r.integers(0, 400, 4):
            now[p] = f"n{k}p{p}"
    texts += [(100 + k, " ".join(words[: 395 - k] + [f"z{k}_{m}" for m in range(5 + k)])) for k in range(0, 60, 3)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    of = brute_components([(i, shingle_set(t)) for i, t in texts])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == dict(zip([i for i, _ in texts], of))


def test_lm_score(docs, nothing):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) + [0]) for i, t in rows()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in words if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    got = lm_score.scores(docs).collect()
    want = collections.Counter((i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in words)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm_score.scores(nothing).count() == 0


def test_lm_is_normalised_and_learns():
    r = np.random.default_rng(1)
    seq = np.tile([0, 1, 2, 3], 2000)
    codes, counts = np.unique((np.r_[lm_score.END, lm_score.END, seq[:-2]] * lm_score.CLASSES + np.r_[lm_score.END, seq[:-1]]) * lm_score.CLASSES + seq, return_counts=True)
    table = lm_score.LogBilinear(int(r.integers(9))).train(codes, counts).table().reshape(-1, lm_score.CLASSES)
    assert np.allclose((10.0**table).sum(1), 1, atol=1e-3)
    assert table[0 * lm_score.CLASSES + 1].argmax() == 2


def test_lm_passes_over_every_trigram(monkeypatch):
    r = np.random.default_rng(2)
    codes = np.sort(r.choice(lm_score.CLASSES**3, 20_000, replace=False))
    counts = r.integers(1, 4, len(codes))
    counts[7] = 10**7
    model, met = lm_score.LogBilinear(), collections.Counter()

    def step(code, w, *rest):
        met.update(code.tolist())
        weights.append((code, w[:, 0]))

    weights = []
    monkeypatch.setattr(model, "step", step)
    model.train(codes, counts)
    assert len(met) == len(codes) and len(weights) >= lm_score.STEPS
    code, w = np.concatenate([c for c, _ in weights]), np.concatenate([x for _, x in weights])
    got = np.bincount(np.searchsorted(codes, code), w, len(codes))
    assert np.allclose(got / got.sum(), counts / counts.sum(), rtol=1e-3)


def test_lm_classes_grow_with_the_vocabulary(spark):
    assert lm_score.frequent(10**6) > lm_score.frequent(1000) > lm_score.FREQUENT
    common_words = [f"w{k}ing" for k in range(100)]  # more than FREQUENT of them, in one suffix class if they had none of their own
    pairs = " ".join(f"w{k}ing w{99 - k}ing" for k in range(100))
    df = spark.createDataFrame([(k, pairs if k < 60 else " ".join(f"u{k}x{m}" for m in range(20))) for k in range(100)], "doc_id long, text string")
    assert lm_score.scores(df).filter("score >= 0 OR score IS NULL").count() == 0
    h, kinds, _ = lm_score.words_of(np.frombuffer(" ".join(common_words).encode(), np.uint8), np.array([0, len(" ".join(common_words))]))
    end = lm_score.frequent(800)
    known = lm_score.Classes([(int(x.view(np.int64)), 5, int(k)) for x, k in zip(h, kinds)], np.full(lm_score.SUFFIXES, 999), np.full(lm_score.SUFFIXES, 99), 1, end)
    assert len(set(known.of(h, kinds).tolist())) == 100 and known.of(h, kinds).max() < end


def test_exact_dedup(docs, nothing):
    text = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows()]
    groups = collections.defaultdict(list)
    for i, t in text:
        groups[t].append(i)
    keep = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    got = exact_dedup.exact_duplicates(docs)
    assert bag(got, "doc_id", "keep_id", "group_size", "text_sha256") == collections.Counter((i, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in text)
    assert got.filter("kept").count() == len(groups)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(groups)
    odd = docs.withColumnsRenamed({"part": "row_key", "key": "Row_Turn", "lang": "__sha"})
    assert collections.Counter(map(tuple, exact_dedup.drop_exact_duplicates(odd).drop("row").collect())).total() == len(groups) and exact_dedup.drop_exact_duplicates(odd).columns == odd.columns
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.drop_exact_duplicates(nothing).count() == 0


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_WORDS, 4])
def test_decontamination(docs, nothing, spark, limit, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", limit)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in BENCH:
        w = word.findall(lower(t or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    want = collections.Counter()
    for i, t in rows():
        w = word.findall(lower(t or ""))
        hit, items = set(), set()
        for x, names in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    items |= names
        want[i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)] += 1
    assert bag(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want
    assert decontaminate.contamination(nothing, bench).count() == 0
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.count() == sum(n for k, n in want.items() if not k[5]) and clean.columns == docs.columns
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    # The longest matches: every pair of places that agrees on a window and not one word further to either side.
    want = collections.Counter()
    for d, t in rows():
        w = word.findall(lower(t or ""))
        for i, u in BENCH:
            b = word.findall(lower(u or ""))
            for x in range(len(w)):
                for y in range(len(b)):
                    n = 0
                    while x + n < len(w) and y + n < len(b) and w[x + n] == b[y + n]:
                        n += 1
                    if n >= min(10, len(b)) and not (x and y and w[x - 1] == b[y - 1]):
                        want[d, "" if i is None else str(i), x, y, n] += 1
    assert want and bag(decontaminate.matches(docs, bench), "doc_id", "item_id", "start", "item_start", "length") == want


def test_decontamination_of_many_like_texts(spark):
    r = np.random.default_rng(8)
    pick = lambda n: " ".join(r.choice(list("abc"), n))
    bench = [(k, pick(int(r.integers(1, 40)))) for k in range(30)]
    texts = [(k, pick(int(r.integers(0, 200)))) for k in range(20)]
    df, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = set()
    for d, t in texts:
        w, hit, names = t.split(), set(), set()
        for i, u in bench:
            b = u.split()
            n = min(10, len(b))
            for y in range(len(b) - n + 1):
                for x in range(len(w) - n + 1):
                    if w[x : x + n] == b[y : y + n]:
                        hit.update(range(x, x + n))
                        names.add(str(i))
        want.add((d, len(w), len(hit), ",".join(sorted(names))))
    got = decontaminate.contamination(df, items).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.items_sha256) for r in got} == {(d, n, h, hashlib.sha256(x.encode()).hexdigest()) for d, n, h, x in want}


def test_toxicity_learns_what_the_noisy_or_says():
    r = np.random.default_rng(6)
    y = np.arange(300) % 3 == 0
    doc, row, col = [], [], []
    for d in range(300):  # one sentence of a toxic document has feature 0; feature 1 is everywhere
        for s in range(3):
            doc.append(d)
            row.append(len(doc) - 1)
            col.append(1)
            if y[d] and s == d % 3:
                row.append(len(doc) - 1)
                col.append(0)
    shape = toxicity.Model(np.array([5, 9], np.uint32), np.zeros(2), toxicity.BIAS)
    model = toxicity.fit(shape, y.astype(int), r.integers(0, 5, 300), np.array(doc), np.array(row), np.array(col))
    x = np.full((2, 4), 1, np.uint32)
    x[0, 0], x[1, 0] = 5, 9
    bad, plain = model.sentence_scores(x, np.array([0, 1]))
    assert bad > 0.8 and plain < 0.1
    assert np.allclose(toxicity.noisy_or(np.array([0.5, 0.5, 0.2]), np.array([0, 0, 2]), 3), [0.75, 0, 0.2])


def test_long_texts(spark):
    """Texts of megabytes, in one line and in many, beside a copy and an empty one."""
    r = np.random.default_rng(12)
    words = np.array([f"w{k}" for k in range(5000)])
    long = " ".join(r.choice(words, 300_000))
    df = spark.createDataFrame([(1, long), (2, long), (3, long.replace(" ", "\n")), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(long.split()[1000:1050]))], "item_id long, text string")
    assert {r.doc_id: r.n_removed for r in suffix_dedup.repeated_passages(df).collect()} == {1: 0, 2: len(long), 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(df, bench).collect()} == {1: 50, 2: 50, 3: 50, 4: 0}
    lines = long.split()
    pairs = collections.Counter(zip(lines, lines[1:]))
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.deduplicated(df).collect()}
    assert got[1] == (1, 0) and got[2] == (1, 1) and got[4] == (1, 0) and got[3][0] == 300_000 and 0 < got[3][1] <= 2 * sum(n - 1 for n in pairs.values())
    assert {r.doc_id: r.n_tokens for r in lm_score.scores(df).collect()} == {1: 300_001, 2: 300_001, 3: 300_001, 4: 1}
    assert pii.personal_data(df).count() == 4 and packing.packed(df).groupBy("doc_id").count().count() == 4


def test_toxicity(spark, docs, nothing):
    r = np.random.default_rng(5)
    vocabulary = [f"v{a}{b}" for a in "bcdfgh" for b in "aeiouklm"]
    rows_, labels = [], []
    for k in range(400):
        text = " ".join(r.choice(vocabulary, 60)) + ". " + " ".join(r.choice(vocabulary, 30))
        bad = k % 5 == 0
        rows_.append((k, text + f". you rascal{vocabulary[k % 40]} go. fine." if bad else text))
        labels.append((k, int(bad)))
    df, known = spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, known)
    got = {x.doc_id: x for x in toxicity.scores(df, model).collect()}
    assert all(got[i].predicted == y for i, y in labels) and all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, x in got.items())
    found = toxicity.offending_sentences(df.filter("doc_id = 0"), model).collect()
    assert len(found) == 1 and "rascal" in found[0].sentence
    assert rows_[0][1].encode()[got[0].worst_start : got[0].worst_end].decode() == found[0].sentence and got[0].worst_score == found[0].score
    again = toxicity.train(df.unionByName(df), known.unionByName(known))  # repeated rows change nothing
    assert np.array_equal(again.features, model.features) and np.allclose(again.weights, model.weights)
    assert toxicity.scores(docs, model).filter("score < 0 OR score > 1 OR score IS NULL OR (worst_start < 0) <> (worst_end < 0) OR worst_score > score + 1e-9").count() == 0
    assert toxicity.scores(docs, model).count() == docs.count() and toxicity.scores(nothing, model).count() == 0
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    none = toxicity.train(df, known.limit(0))
    assert toxicity.scores(df, none).filter("score > 1e-6").count() == 0
