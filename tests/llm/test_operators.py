"""Each operator against a plain version, over texts and rows at the edge: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from wardlake.llm import bytebpe, chat_format, fingerprints, jaccard_join, packing, secret_scan, segments, token_counts, token_files, topk, toxicity, unigram, unigram_codec
from wardlake.llm.components import components
from wardlake.llm.tables import order_chunk

BPE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
RANDOM = random.Random(5)
WORDS = ["the", "of", "rain", "falls", "on", "warm", "stone", "Été", "ß", "naïve", "日本", "x1", "stop.", "end!"]


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") + ("\n" if rng.random() < 0.1 else "") for _ in range(n))


BASE = prose(300, 1)
TEXTS = [
    (1, ""), (2, None), (3, "one"), (4, BASE), (5, BASE), (5, BASE), (6, BASE.replace("rain", "snow", 1)), (7, prose(300, 2)), (None, "no id but some words here"),
    (None, None), (9, prose(9000, 3)), (10, " \n\t "), (11, "two words"), (12, "Two words"), (13, "a  b   c\n\n d <|endoftext|> e\x00f 😀 it's"), (14, "\x1c \x85 ſK"),
    (15, BASE + " tail"), (16, "x" * 5000), (-3, "the of rain"), (17, "▁ marker ▁▁ text"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, node string, length string, ids string, _row string, predicted string, spans string, n string, region string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", len(t) if t else None, *["clash"] * 9) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return str(row)


# --- fingerprints


def paragraphs(text):
    found = re.findall(r"[^\n]{120,}?[.!?](?=[ \t\n\x0b\f\r]|$)|[^\n]+", text or "")
    return {p.strip(" ") for p in found if p.strip(" ")}


def likeness(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprint_likeness(spark):
    lines = [f"line {i}" for i in range(900)]
    pairs = [("", None), ("a\nb", "a\nc"), ("\n".join(lines), "\n".join(lines[100:])), ("\n".join(lines[:300]), "\n".join(lines[300:])), (BASE, BASE), ("x\nx\nx", "x")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, a string, b string")
    got = {r["k"]: r for r in fingerprints.compared(rows, "a", {"b": "b"}).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i]["near_b"] == pytest.approx(likeness(a, b))
    assert got[4]["fingerprint"] == got[4]["b_fingerprint"]


def test_peeling_counts_every_difference(spark):
    """Many pairs with 0 to 80 differing digests: sums that look like a digest by chance don't change a count."""
    rng = random.Random(9)
    pairs = []
    for i in range(1500):
        a, b = ({f"{rng.random()}" for _ in range(rng.randint(0, 40))} for _ in range(2))
        both = {f"{rng.random()}" for _ in range(rng.randint(0, 20))}
        pairs.append((i, sorted(a | both), sorted(b | both), len(a) + len(b)))
    rows = spark.createDataFrame([(i, "\n".join(a), "\n".join(b), n) for i, a, b, n in pairs], "k int, a string, b string, want int")
    rows = rows.withColumns({c: fingerprints.digests(F.col(x)) for c, x in (("da", "a"), ("db", "b"))})
    rows = rows.withColumns({c: fingerprints.sketch(F.col(x)) for c, x in (("sa", "da"), ("sb", "db"))})
    got = fingerprints.differing(rows, {"n": ("da", "db", "sa", "sb")})
    assert got.where(F.col("n") != F.col("want")).count() == 0


def test_near_copies_of_one_line_are_alike(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    texts = [" ".join(words), "。".join("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(12)) for _ in range(6)), "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(90)), "Short one. Then two! " * 2 + "Three is here? Four."]
    rows = spark.createDataFrame([(i, t, t[:-3] + "zzz") for i, t in enumerate(texts)], "k int, a string, b string")
    got = {r["k"]: r["near_b"] for r in fingerprints.compared(rows, "a", {"b": "b"}).collect()}
    assert all(0.4 < got[i] < 1 for i in range(len(texts))), got


def test_fingerprint_order(docs, nothing):
    got = fingerprints.with_next(docs).collect()
    order = sorted(((i, t or "") for i, t in TEXTS), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    want = [(i, t, n[1]) for (i, t), n in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(map(key, ((r[0], r[1], r[2]) for r in got))) == sorted(map(key, want))
    assert fingerprints.with_next(nothing).count() == 0


# --- packing and token files


def ids_of(text):
    return [*BPE.encode(text or "", add_special_tokens=False).ids, 0]


def test_packing(docs, nothing):
    rows = packing.pack(packing.pieces(docs, with_ids=True)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i in {i for i, _ in TEXTS}:
        want = sorted(ids_of(t) for k, t in TEXTS if k == i)
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == sum(map(len, want))
        if len(want) == 1:
            assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 2048 for r in own[1:])
            assert np.frombuffer(b"".join(bytes(r["ids"]) for r in own), "<u4").tolist() == want[0]
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *[r["length"] for r in own[:-1]]]).tolist() and sum(r["length"] for r in own) <= 2048
    assert packing.pack(packing.pieces(nothing)).count() == 0


def test_packing_plan():
    rng = np.random.default_rng(3)
    for n, high in ((1, 5), (400, 2047), (5000, 900), (20000, 2047)):
        lengths, counts = np.unique(rng.integers(1, high + 1, n), return_counts=True)
        planned = packing.plan(dict(zip(lengths.tolist(), counts.tolist(), strict=True)))
        got = np.zeros(2049, int)
        for config, times in planned:
            assert sum(config) <= 2048
            for length in config:
                got[length] += times
        assert got[lengths].tolist() == counts.tolist() and got.sum() == n
        large = int(counts[lengths > 1024].sum())
        least = max(-(-int((lengths * counts).sum()) // 2048), large)
        assert sum(t for _, t in planned) <= least * 1.06 + 2


def test_packed_sequences(docs):
    packed = packing.pack(packing.pieces(docs, capacity=64, with_ids=True), capacity=64)
    got = packing.sequences(packed).collect()
    assert all(len(r["ids"]) == 4 * r["n_tokens"] <= 256 for r in got) and sum(r["n_tokens"] for r in got) == sum(len(ids_of(t)) for _, t in TEXTS)


def test_token_files(docs, nothing):
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read(token_files.write(docs)).collect())
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start, want = 0, []
    for i, t in order:
        ids = ids_of(t)
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [(a, c, d) for a, _, c, d in got] == [(a, c, d) for a, _, c, d in want] and [g[1] for g in got] == [w[1] for w in want]
    assert token_files.read(token_files.write(nothing)).count() == 0


def test_blank_lines():
    spaces = ["\n\n", "\n\n\n", "\n\n\n\n", " \n\n", "\t\n\n", "\t\t", "\r\n", "\r\n\r\n", "\n \n", "\n\n ", "\n  ", "\u3000\n\n", "\xa0\n", "\x0b\x0c"]
    after = ["b", "7", "-", "'s", "é", "Ж", "日本", "\u0301", "😀", "\x00", " b", "", "<|endoftext|>"]
    texts = [a + s + b for a in ("a", "", "é", "7.", "日", "\n") for s in spaces for b in after]
    rng = random.Random(8)
    texts += ["".join(rng.choice([*spaces, *after, " ", "\n", "a"]) for _ in range(12)) for _ in range(3000)]
    for part in ([t for t in texts if "<|" not in t], texts):
        for i, j, ids, offsets in bytebpe.encoded(pa.array(part)):
            for k in range(i, j):
                assert ids[offsets[k - i] : offsets[k - i + 1]].tolist() == ids_of(part[k])[:-1], repr(part[k])


def test_dictionary_forgets(monkeypatch):
    monkeypatch.setattr(segments, "REMEMBERED", 50)
    from wardlake.llm.bytebpe import Encoder, vocabulary_path

    texts = [prose(60, s) for s in range(30)]
    encoder = Encoder(vocabulary_path())
    for batch in (texts[:10], texts[10:20], texts[20:], texts[:5]):
        for i, j, ids, at in encoder.dictionary.slices(pa.array(batch)):
            for k in range(i, j):
                assert ids[at[k - i] : at[k - i + 1]].tolist() == BPE.encode(batch[k], add_special_tokens=False).ids


# --- n-gram Jaccard join


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def grouped(rows, k, num):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= num * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root[a], root[b]
                root = [y if r == x else r for r in root]
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root[b] == root[a] and rows[b][0] is not None]
        out.append((i, len(sets[a]), min(ids, default=None) if sets[a] else i, root[a]))
    return out


def test_jaccard_join(docs, nothing):
    got = jaccard_join.join_components(docs, jaccard_join.Rule(3, 90, 100)).collect()
    want = grouped(TEXTS, 3, 90)
    assert sorted(map(key, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(key, (w[:3] for w in want)))
    assert jaccard_join.join_components(nothing, jaccard_join.Rule()).count() == 0


def near_texts(n, families):
    rng = random.Random(11)
    out = []
    for f in range(families):
        base = [f"w{f}_{i}" for i in range(80)]
        for _ in range(n):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return list(enumerate(out))


@pytest.mark.parametrize("leaf", [256, 12])
def test_jaccard_regions(spark, monkeypatch, leaf):
    """Large regions go through pivots, windows and blocks."""
    monkeypatch.setattr(jaccard_join, "LEAF", leaf)
    rows = near_texts(40, 3)
    got = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), jaccard_join.Rule(3, 80, 100)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((w[0], w[2]) for w in grouped(rows, 3, 80))


def test_one_of_each(docs):
    left = jaccard_join.one_of_each(docs, jaccard_join.Rule(3, 80, 100))
    assert left.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in left.collect()]
    want = grouped(TEXTS, 3, 80)
    assert len([r for r in rows if shingles(r[1], 3)]) == len({w[3] for w in want if w[1]})
    assert len([r for r in rows if not shingles(r[1], 3)]) == len([w for w in want if not w[1]])


def test_components_of_hot_nodes(spark):
    """A node with nearly all edges, as the smallest and as the largest of its component."""
    edges = [(0, i) for i in range(1, 3000)] + [(9000, i) for i in range(4000, 6000)] + [(2999, 3500), (5999, 6500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(r == (0 if n <= 3500 else 4000) for n, r in got.items()) and len(got) == 3001 + 2002
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}


# --- toxicity


def toxic_tables(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        words = [rng.choice(WORDS) for _ in range(30)]
        if toxic:
            words[5] = rng.choice(["blockhead", "vermin"])
        if rng.random() < (0.8 if toxic else 0.1):
            words[9] = "immigrants"
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, docs, nothing):
    rows, labels = toxic_tables(spark)
    held = F.col("doc_id") % 5 != 2
    fair, plain = toxicity.fit(rows, labels, held), toxicity.fit(rows, labels, held, swap_penalty=0.0)
    got = toxicity.with_toxicity(rows, fair).where(~held).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 3 == 0) for r in got)
    probe = pa.array(["the rain falls on immigrants", "the rain falls on women", "the rain falls on stone", "", None])
    a, b = fair.scores(probe), plain.scores(probe)
    assert a[0] - a[2] < 0.2 * (b[0] - b[2]) and abs(a[0] - a[1]) < 0.05 and a[3] == a[4]
    out = toxicity.with_toxicity(docs, fair)
    assert out.count() == len(TEXTS) and set(out.columns) == set(docs.columns)
    assert toxicity.with_toxicity(nothing, toxicity.fit(nothing, labels)).count() == 0
    assert {r["score"] for r in toxicity.with_toxicity(docs, toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


# --- secrets


def test_toxicity_with_a_repeated_labelled_id(spark):
    """An id with very many rows counts once in the fit."""
    docs = spark.createDataFrame([(1, "vile awful words")] * 3000 + [(i, "calm words" if i % 2 else "vile words here") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or i == 1)) for i in range(1, 40)], "doc_id long, toxic int")
    sample = toxicity._sample(docs, labels, F.lit(True), 100, "text")
    assert sample.count() == 39
    scores = {r["doc_id"]: r["score"] for r in toxicity.with_toxicity(docs.distinct(), toxicity.fit(docs, labels)).collect()}
    assert min(scores[i] for i in (2, 4, 6)) > max(scores[i] for i in (3, 5, 7))


def test_secret_spans(docs, nothing):
    key = "AKIA" + "Q7" * 8
    text = f'x = {"ab" * 20}\npassword: hunter22 Token="{"d0" * 12}" secret=abc api-key: "k" {key} ſecret=abcdefgh\n'
    base, both = secret_scan.scan(text)
    plain = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m.group(2)) >= 6]
    plain += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    plain += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    assert base == sorted(plain) and set(base) <= set(both)
    out = secret_scan.with_secrets(docs)
    assert out.count() == len(TEXTS) and out.where("n_assign + n_access + n_hex > 0").count() == 0
    assert secret_scan.with_secrets(nothing).count() == 0 and secret_scan.redact(docs).columns == docs.columns


@pytest.mark.parametrize(
    ("text", "secret"),
    [
        ("SECRET_KEY=abc123-DEF456_ghi789 end", "abc123-DEF456_ghi789"),
        ("secretKey=wJalrXUtnFEMI+K7MDENG/bPxRfiCYzzQQ\nnext", "wJalrXUtnFEMI+K7MDENG/bPxRfiCYzzQQ"),
        ("auth_key: Zm9v+YmFy/QUJDRA12345==", "Zm9v+YmFy/QUJDRA12345=="),
        ('secret_key = f"abc123DEF456ghi789"', "abc123DEF456ghi789"),
        ('secret_key = rb\'abc123DEF456ghi789\'', "abc123DEF456ghi789"),
        ('secret_key = """abc123DEF456ghi789"""', "abc123DEF456ghi789"),
        ('secret_key = ("abc123DEF456ghi789")', "abc123DEF456ghi789"),
        ('secret_key: [ "abc123DEF456ghi789" ]', "abc123DEF456ghi789"),
        ('x: secret_key=abc123DEF456ghi789', "abc123DEF456ghi789"),
    ],
)
def test_whole_secrets_are_found(text, secret):
    assert secret in [text[s:e] for s, k, e in secret_scan.literal_spans(text)]
    assert not set(re.findall(r"[A-Za-z0-9]{6,}", secret)) & set(re.findall(r"[A-Za-z0-9]{6,}", secret_scan.redacted(text)))


def test_secrets_in_sums():
    text = 'a = "abc123DEF"\nb = "456ghiJKL"\nsecret_key = a+b\nauth_key = "Qw12er" + \\\n  "Ty34ui"\nmaster_key = ("Qw12er"\n  + "Ty34uiOP")'
    found = [text[s:e] for s, k, e in secret_scan.literal_spans(text)]
    assert found == ["abc123DEF", "456ghiJKL", "Qw12er", "Ty34ui", "Qw12er", "Ty34uiOP"]


def test_secret_scan_of_chained_assignments_is_linear():
    assert secret_scan.literal_spans("a=" * 100_000 + " token") == []


def test_secret_constants():
    code = 'const part = "Zx81-kQpo";\nlet other = "weather";\nconfig = {"db_password": part + "99Lmn"}\nprint(other)\nprivateKey := "9f-AAbb22kd"\npassword_hint = "my first pet 22"\n'
    found = {code[s:e] for s, k, e in secret_scan.scan(code)[1] if k == 3}
    assert found == {"Zx81-kQpo", "99Lmn", "9f-AAbb22kd"}
    assert secret_scan.redacted("token = abcdef12 and on") == "[SECRET] and on" and secret_scan.redacted(None) is None
    assert secret_scan.scan("the secret: nothing is as it seems, a token of love")[1] == secret_scan.base_spans("the secret: nothing is as it seems, a token of love")


def test_secret_of_many_literals_and_long_names():
    parts = [f"Zx{i}-kQ{i:02d}p" for i in range(40)]
    chain = "".join(f'p{i} = {f"p{i - 1} + " if i else ""}"{v}"\n' for i, v in enumerate(parts))
    name = "generated_" * 12 + "password"
    for code in (chain + "password = p39\n", "all = " + " + ".join(f'"{v}"' for v in parts) + "\npassword = all\n", chain + f"{name} = p39\n", chain + f'"{name}": p39 + "tail"\n'):
        found = {code[s:e] for s, k, e in secret_scan.scan(code)[1] if k == 3}
        assert found - {"tail"} == set(parts) and not any(v in secret_scan.redacted(code) for v in parts)
    text = f'{name} = "9f-AAbb22kd" 1x.y-{name}:"7c-DDee55mn"'
    assert {text[s:e] for s, k, e in secret_scan.scan(text)[1] if k == 3} == {"9f-AAbb22kd", "7c-DDee55mn"}
    double = 'a0 = "Zx81-k"\n' + "".join(f"a{i + 1} = a{i} + a{i}\n" for i in range(3000)) + "password = a3000\n"
    assert [double[s:e] for s, k, e in secret_scan.scan(double)[1] if k == 3] == ["Zx81-k"]
    long = "secret " + "a." * 200_000 + ' x = "b"'
    assert not [x for x in secret_scan.scan(long)[1] if x[1] == 3]


# --- unigram counts and codec


def unigram_library():
    v = unigram.load()
    vocab = [("<unk>", 0.0)] * v.size
    for piece, (i, score) in v.pieces.items():
        vocab[i] = (piece.replace(" ", "▁"), score)
    for b, i in enumerate(v.byte_ids):
        vocab[i] = (f"<0x{b:02X}>", 0.0)
    vocab = [(p, s) if i == 0 or p != "<unk>" else (f"<pad{i}>", 0.0) for i, (p, s) in enumerate(vocab)]
    return models.Unigram(vocab, unk_id=0, byte_fallback=True)


def test_unigram(docs, nothing):
    library = unigram_library()
    texts = [t for _, t in TEXTS] + ["".join(RANDOM.choice(list("abet ionh  é日ł\n(;19")) for _ in range(40)) for _ in range(300)]
    want = [[t.id for t in library.tokenize("▁" + t.replace(" ", "▁"))] if t else [] for t in texts]
    column = pa.array(texts, pa.string())
    assert token_counts.counter().counts(column).tolist() == list(map(len, want))
    codec = unigram_codec.codec()
    got = [ids[at[k] : at[k + 1]].tolist() for i, j, ids, at in codec.encoded(column) for k in range(j - i)]
    assert got == want
    back = unigram_codec.with_text(unigram_codec.with_ids(docs)).collect()
    both = unigram_codec.round_trip(docs).collect()
    assert sorted((str(r["doc_id"]), r["decoded"], bytes(r["ids"])) for r in back) == sorted((str(r["doc_id"]), r["decoded"], bytes(r["ids"])) for r in both)
    assert all(r["decoded"] == (r["text"] or "").replace("▁", " ") for r in both) and len(both) == len(TEXTS)
    assert token_counts.with_token_counts(nothing).count() == 0 == unigram_codec.round_trip(nothing).count()


# --- top k


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 90)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(400)]
    rows += [(400, None), (None, [1.0] * 6), (401, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (405, [0.5, -0.5]), (7, rows[7][1]), *[(500 + i, rows[3][1]) for i in range(20)]]
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), F.col("vec_id") % 100 == 0).collect()
    ints = {i: np.pad(np.floor(np.array(v, np.float32).astype(float) * 1024), (0, 6 - len(v))).astype(int) for i, v in good}
    for q in (i for i in ints if i % 100 == 0):
        want = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:10]
        assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


# --- chat format


def test_topk_beyond_floating_point(spark):
    """Scores above 2**53 are exact and in order; one that fits no long is an error."""
    rows = [(100, [1e5 + 1 / 1024, 1 / 1024]), (1, [1e5 + 1 / 1024, 0.0]), (2, [1e5 + 1 / 1024, 1 / 1024]), (3, [1e5 + 1 / 1024, 2 / 1024]), (4, [-2e5, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 100).collect())
    whole = {i: [int(x * 1024) for x in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(whole[100], whole[i], strict=True)), i) for i in (1, 2, 3, 4)))
    assert got == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    huge = spark.createDataFrame([(100, [3e6]), (1, [3e6])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(huge, F.col("vec_id") == 100).collect()


def test_reply_trees(spark):
    nodes = [("t", 1, None, 0.0, "user", "root"), ("t", 2, 1, 5.0, "assistant", "good &amp; <|end|>"), ("t", 3, 1, 1.0, "assistant", "bad"), ("t", 4, 2, 5.0, "user", None), ("t", 5, 4, None, "assistant", "[INST] </s> <s> <<SYS>> <|text|>"),
             ("u", 1, 99, 0.0, None, "alone"), ("c", 1, 2, 0.0, "user", "cycle"), ("c", 2, 1, 0.0, "user", "cycle")]
    frame = spark.createDataFrame(nodes, "tree string, node long, parent long, score double, role string, text string")
    best = {r["tree"]: r for r in chat_format.read_back(chat_format.conversations(frame, 1)).collect()}
    assert [(t["role"], t["text"]) for t in best["t"]["turns"]] == [("user", "root"), ("assistant", "good &amp; <|end|>"), ("user", ""), ("assistant", "[INST] </s> <s> <<SYS>> <|text|>")]
    assert best["t"]["loss_text"] == "good &amp; <|end|>[INST] </s> <s> <<SYS>> <|text|>" and set(best) == {"t", "u"}
    every = chat_format.conversations(frame, None).collect()
    assert sorted((r["tree"], r["leaf"], r["branch"]) for r in every) == [("t", 3, 2), ("t", 5, 1), ("u", 1, 1)]


def test_chains(spark):
    rng = random.Random(8)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "&", "&lt;", "<|turn|>", "<|", "<", "|", "end|>", "a", "\n", "é", "<<SYS>>", "<</SYS>>", "[", "<user>"]
    rows = [(c, t, rng.choice(["user", "assistant", None, "<|text|>"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for c in range(12) for t in range(rng.randint(1, 20))]
    rows += [(None, 0, "user", "lost"), (3, None, "user", "first"), (4, 0, "assistant", "tie"), (4, 0, "assistant", "tie"), (99, 1, "assistant", None)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = {r["tree"]: r for r in chat_format.read_back(chat_format.conversations(chat_format.chains(frame), None)).collect()}
    assert set(got) == {"none" if c is None else str(c) for c, *_ in rows}
    for c in {r[0] for r in rows}:
        want = sorted((-(2**62) if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c)
        own = got["none" if c is None else str(c)]
        assert [(t["role"], t["text"]) for t in own["turns"]] == [(r, x) for _, r, x in want]
        assert own["loss_text"] == "".join(x for _, r, x in want if r == "assistant")
    assert chat_format.conversations(chat_format.chains(frame.limit(0)), None).count() == 0


def test_order_chunks(spark):
    rows = spark.createDataFrame([(v,) for v in [None, *range(-50, 50), *[7] * 80, 10**15]], "v long")
    got = rows.withColumn("c", order_chunk(rows, "v")).collect()
    by = sorted((r["v"], r["c"]) for r in got if r["v"] is not None)
    assert [c for _, c in by] == sorted(c for _, c in by) and len({c for v, c in by if v == 7}) == 1 and {r["c"] for r in got if r["v"] is None} == {-1}


def test_equal_texts_share_a_fingerprint(docs):
    got = fingerprints.compared(docs, "text", {}).select("text", "fingerprint").collect()
    assert len({r["fingerprint"] for r in got if r["text"] == BASE}) == 1
    assert hashlib.sha256(got[0]["fingerprint"].encode()).hexdigest()
