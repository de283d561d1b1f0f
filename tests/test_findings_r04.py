"""Findings of the check in round 3: memory and time of the encoder, shuffles of the token window, repeated feature work."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F

from pyspark.ml.feature import RegexTokenizer

from wardlake import fixed
from wardlake.llm import bytebpe, segments
from wardlake.functions import rules, text
from wardlake.operators import detect, model, secrets
from wardlake.plans import streaming_jobs
from wardlake.streaming import windows


def test_dictionary_holds_arrays_only():
    """The pipeline went over an executor's memory: a remembered segment may cost some tens of bytes, not an object or two."""
    rng = random.Random(5)
    words = [rng.randbytes(6).hex() for _ in range(100_000)]
    column = pa.array([" ".join(words[i : i + 500]) for i in range(0, len(words), 500)])
    blanks = lambda data, offsets: np.flatnonzero((data == 0x20) | segments.text_starts(data, offsets))
    segments.run_keys(np.zeros(1, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64))  # its tables of powers
    segments.run_keys(np.zeros(1, np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64), 1)
    tracemalloc.start()
    try:
        held = segments.Dictionary(lambda pieces: [np.array([len(p)], np.uint16) for p in pieces], blanks, np.uint16)
        assert sum(int(n.sum()) for _, _, n, _ in held.slices(column)) == sum(len(t) for t in column.to_pylist())
        each = tracemalloc.get_traced_memory()[0] / held.count
    finally:
        tracemalloc.stop()
    assert held.count >= 100_000 and each < 90


def test_dictionary_with_keys_that_share_their_slots(monkeypatch):
    """Keys whose low bits agree, and different segments with one first key, keep their own rows."""
    plain = segments.run_keys
    monkeypatch.setattr(
        segments, "run_keys", lambda d, s, e, which=0: plain(d, s, e, which) if which else (e - s).astype(np.uint64) << np.uint64(40)
    )
    words = ["a" * n for n in range(1, 90)] + ["b" * n for n in range(1, 90)]
    column = pa.array([" ".join(words), None, "", " ".join(reversed(words))])
    blanks = lambda data, offsets: np.flatnonzero((data == 0x20) | segments.text_starts(data, offsets))
    held = segments.Dictionary(lambda pieces: [np.array(list(p), np.uint16) for p in pieces], blanks, np.uint16)
    for _ in range(2):
        got = [bytes(n[o[k] : o[k + 1]].tolist()).decode() for _, _, n, o in held.slices(column) for k in range(len(o) - 1)]
        assert got == [t or "" for t in column.to_pylist()]


def test_plain_words_are_merged_without_a_split(monkeypatch):
    """op2 and op5 were over their CPU budget: a word of ASCII letters goes to the library's merges at once."""
    encoder = bytebpe.Encoder(bytebpe.vocabulary_path())
    words = ["hello", " world", "Zq", " a", " Internationalisation"]
    want = [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    assert [list(x) for x in encoder.encode([b"x1", " é".encode(), b" 'll"])] == [
        encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in ("x1", " é", " 'll")
    ]
    monkeypatch.setattr(encoder, "_ids", lambda segment: 1 / 0)
    assert [list(x) for x in encoder.encode([w.encode() for w in words])] == want


def test_cuts_and_ids_on_mixed_text():
    """Whole texts of random marks, breaks, blanks and letters get the library's ids."""
    rng = random.Random(9)
    parts = ["a", "Bc", "9", " ", "  ", "\n", "\r\n", "\t", "'", "'s", "-", "é", "日本", " ", "x1", "!?", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)] + [None, "", " ", "\n", "a\n", " \n a"]
    tokenizer = bytebpe.encoder(bytebpe.vocabulary_path()).tokenizer
    got = [ids[o[k] : o[k + 1]].tolist() for _, _, ids, o in bytebpe.encoded(pa.array(texts)) for k in range(len(o) - 1)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def _texts(spark):
    rng = random.Random(4)
    parts = [" a", " bb", "\n", " [CP-CANARY-x1]", " __SYSTEM_PROMPT_SECRET_a1__", " <!--", " SYSTEM_CANARY_q", " -->", " x-", " A_", " sk-9", "  ghp_1", "c"]
    rows = [(i % 70 if i < 90 else i, "".join(rng.choices(parts, weights=[9, 9, 3] + [1] * 9 + [5], k=rng.randint(0, 60)))) for i in range(160)]
    return spark.createDataFrame(rows + [(None, "a sk-1 b"), (500, None), (501, ""), (502, "   "), (503, "w " * 40 + "AKIA")], "id long, text string")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_texts_are_guarded_as_their_tokens(spark, monkeypatch):
    """judged in the row, with the rows of the token form; ids of several texts, nulls and empty texts included."""
    df = _texts(spark)
    for size in (3, 30):
        want = _rows(windows.guard_tokens(windows.tokens(df, "id"), "id", fixed.STREAM_SECRET_MARKERS, size))
        assert any(r[3] for r in want) and any(r[0] is None for r in want)
        assert _rows(windows.guard_texts(df, "id", fixed.STREAM_SECRET_MARKERS, size=size)) == want
        with monkeypatch.context() as m:
            m.setattr(windows, "MAX_SHARED", 2)
            assert _rows(windows.guard_texts(df, "id", fixed.STREAM_SECRET_MARKERS, size=size)) == want


def test_token_window_shuffles_no_token(spark, tmp_path):
    """where ids are unique, the plan of the query has no exchange."""
    docs = [(i, f"text {i} with some words", "en", "web", 20) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = streaming_jobs.stream_token_window(spark, str(tmp_path))
    assert out.count() == 10 * 6 + 10 * 2 + 10 * 5  # "... words AKIA", "see sk-1", the whole text
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_folds_share_the_counts_of_words(spark, monkeypatch):
    """texts are taken apart once, not anew for every fold."""
    rng = random.Random(2)
    rows = [(f"{rng.choice(['good fine', 'bad vile'])} w{rng.randint(0, 9)}", i % 2, i % 3) for i in range(90)]
    rows = [("good fine " + t if y else "bad vile " + t, y, f) for t, y, f in rows]
    taken, plain = [], RegexTokenizer.transform
    monkeypatch.setattr(RegexTokenizer, "transform", lambda self, *a: taken.append(1) or plain(self, *a))
    got = model.cross_validate(spark.createDataFrame(rows, "text string, label int, fold int"))
    assert sorted(r["fold"] for r in got.collect()) == [0, 1, 2] and len(taken) == 1


def test_patterns_with_a_first_test_match_as_before(spark):
    """cheap tests before word edges change no match."""
    rng = random.Random(8)
    parts = ["hang", "up", "kill", "-9", "a", "b", "é", "x", ".", "-", "_", " ", " ", "  ", "to", "mockingbird", "drop the table", "hate", "idiot", "dumb", "abcd1234EFGH", "Q2FmZSBhdSBsYWl0", "́", "\u200b", "а", "=", "ñ"]
    said = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)] + ["change up", "hang up", "exhang up", "é hang  up", None]
    df = spark.createDataFrame([(t,) for t in said], "x string")
    x = F.col("x")
    every = [p for k, ps in fixed.SAFE_CONTEXTS.items() for p in ps] + [r"\bup|kill\b", r"\bup(?:\||x)", r"\bdumb?", r"\bto[|]|a"]
    terms = "|".join(fixed.HOSTILE_TERMS)
    old = df.select(
        *[F.coalesce(x.rlike("(?U)" + p), F.lit(False)) for p in every],
        F.regexp_replace(x, r"(?U)(?<=\b[a-zA-Z])[\s._\-]+(?=[a-zA-Z]\b)", ""),
        F.regexp_extract_all(x, F.lit(rf"(?<!{text.WORD_CHAR})(?:{terms})(?!{text.WORD_CHAR})"), F.lit(0)),
        F.translate(F.translate(x, fixed.HOMOGLYPHS_FROM, fixed.HOMOGLYPHS_TO), fixed.ZERO_WIDTH, ""),
        F.array_max(F.transform(secrets.tokens(x), secrets.entropy_bits)),
    )
    new = df.select(
        *[F.coalesce(rules.any_of(x, [p], ignore_case=False), F.lit(False)) for p in every],
        text.join_spaced_letters(x), F.regexp_extract_all(x, F.lit(detect._TERMS), F.lit(0)), text.fold_marks(x),
        F.when(F.size(secrets.tokens(x)) > 0, secrets.most_bits(secrets.tokens(x))),
    )
    assert [tuple(r) for r in old.collect()] == [tuple(r) for r in new.collect()]


def test_places_are_settled_before_word_edges():
    """the pattern that looks for a word edge begins with the letters behind it."""
    assert rules.led(r"\bhang\s+up\b") == r"(?=hang)\bhang\s+up\b"
    assert rules.led(r"\bhang|up") == r"\bhang|up" and rules.led(r"\bdumb?") == r"\bdumb?"
