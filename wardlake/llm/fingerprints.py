"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs are its lines, cut after words whose hash meets a condition (in scripts without blanks,
characters): in texts of less than 1,024 characters one word in four and also at sentence ends, so that a short text has several; from there on
one word in eight, sixteen and so on, half as many whenever the length grows by the factor 2.8, so that long texts have more paragraphs, but not as
many more. A word that ends a paragraph in a long text ends one in a shorter text too, so that
copies on two sides of a limit still share some. An edit changes only the paragraphs around it. Each distinct
paragraph has a digest of 50 bits, of which the last 14 check the others, with a one above them. It goes into one cell of each of three rows of
cells; a cell keeps the sum of its digests, so that one whole number holds how many there are and what they add up to. Subtracting the sketches of two versions leaves the digests that
only one of them has. Peeling finds cells with a single digest, takes it out of its other cells, and so
on. When peeling gets stuck, the sketch was too small: the digests are split by further
bits and each part is tried with a sketch of its own, which is together a larger sketch (a
part that looks too full is split on before it is tried); parts that are stuck again are split again. Parts are flat
arrays of digests, those of the second text negative: structs inside of lambdas cost far more than the sums. What is left after the last
retry (tens of thousands of differing paragraphs) is compared digest by digest.

Likeness of two fingerprints is the number of shared digests over the number of digests of both.

Defined results: a null or empty text has no paragraphs; two such texts are alike (1); blank lines are no
paragraphs; a paragraph counts once however often it stands in a text; very long texts are taken
whole; repeated rows have equal fingerprints; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions.rows import settle
from wardlake.llm.tables import order_chunk, shuffle_width

#: A digest: KEY_BITS of a hash, CHECK_BITS below them, and a one at bit ONE.
KEY_BITS, CHECK_BITS, ONE = 36, 14, 55
#: Sums are taken modulo this, so that no text is too long; the sum of a difference is taken nearest to zero.
MODULUS = 1 << 62
ROWS, WIDTH = 3, 8
#: Cells of a row in the sketches of parts.
PART_WIDTH = 4
ROUNDS = 6
PARTS = 4
RETRIES = 8
#: The first of the bits of a digest that deal it to a part; those before choose its cells.
SPLIT_FROM = CHECK_BITS + 9
#: A sketch that is thought to hold more differing digests than this share of its cells is split further before it is tried.
FULL = 0.6
#: The same for parts: small sketches get stuck sooner, and a part that is stuck has been tried for nothing.
PART_FULL = 1 / 3
#: Scripts that are written without blanks: each character counts as a word.
SCRIPTS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Below U+0E00 are none of these, so the other characters are not looked up in the tables of scripts.
WORD_END = rf"(?<=[\s[[^\x00-\x{{DFF}}]&&[{SCRIPTS}]]])"
#: Texts shorter than this have the finest paragraphs: after words whose hash ends with so many set bits, and at sentence ends.
FINE_CHARS, FINE_BITS = 1024, 2
#: One bit more from FINE_CHARS on, and for each growth of the length by 2 ** STEP.
STEP = 1.5
#: Chunks of the order for each shuffle partition.
CHUNKS = 16
SENTENCE_END = r"\n|(?<=[.!?…؟۔।॥]\s)|(?<=[.!?…؟۔।॥][\"'”’»)]\s)|(?<=[。！？｡])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""

    def cut(whole: Column) -> Column:
        more = F.floor(F.log2(F.greatest(F.length(whole), F.lit(FINE_CHARS)) / FINE_CHARS) / STEP).cast("int") + 1
        fine = F.length(whole) < FINE_CHARS
        bits = (1 << FINE_BITS) * F.when(fine, 1).otherwise(F.pow(F.lit(2), more)).cast("long") - 1
        marked = let(bits, lambda m: F.array_join(F.transform(F.split(whole, WORD_END), lambda w: F.when(F.xxhash64(w).bitwiseAND(m) == m, F.concat(w, F.lit("\n"))).otherwise(w)), ""))
        return F.when(fine, F.split(marked, SENTENCE_END)).otherwise(F.split(marked, "\n"))

    found = F.transform(let(F.coalesce(text, F.lit("")), cut), lambda p: F.trim(p))
    keys = F.transform(F.filter(found, lambda p: p != ""), lambda p: F.xxhash64(p).bitwiseAND(_long((1 << KEY_BITS) - 1)))
    return F.array_distinct(F.transform(keys, lambda k: F.shiftleft(k, CHECK_BITS) + _check(k) + _long(1 << ONE)))


def _check(key: Column) -> Column:
    return F.hash(key).bitwiseAND(F.lit((1 << CHECK_BITS) - 1)).cast("long")


def is_digest(value: Column) -> Column:
    """Whether a number is a single digest: a one above, and last bits that check the others."""
    key = F.shiftright(value, CHECK_BITS).bitwiseAND(_long((1 << KEY_BITS) - 1))
    return (F.shiftright(value, KEY_BITS + CHECK_BITS) == 1 << (ONE - KEY_BITS - CHECK_BITS)) & (value.bitwiseAND(_long((1 << CHECK_BITS) - 1)) == _check(key))


def _rows(width: int) -> list[tuple[Column, Column]]:
    """For each row of cells, the bits of a digest that choose its cell, and their value at each cell."""
    return [(_long((width - 1) << i), F.array(*[_long(cell << i) for cell in range(width)])) for i in _bits(width)]


def _bits(width: int) -> list[int]:
    """For each row of cells, the first of the bits of a digest that choose its cell."""
    bits = width.bit_length() - 1
    return [CHECK_BITS + row * bits for row in range(ROWS)]


def _signed(x: Column) -> Column:
    return F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x)


def sketch(items: Column, width: int = WIDTH, signed: bool = False) -> Column:
    """The cells of a set of digests: sums of the digests of each cell, modulo MODULUS.

    With ``signed``, of one set minus another, whose digests are negative in ``items``.
    """

    def cell(first_bit: int, here: int) -> Column:
        mask = _long((width - 1) << first_bit)

        def add(total: Column, d: Column) -> Column:
            mine = (F.abs(d) if signed else d).bitwiseAND(mask) == _long(here << first_bit)
            return F.when(mine, (total + d).bitwiseAND(_long(MODULUS - 1))).otherwise(total)

        return F.aggregate(items, _long(0), add)

    sums = F.array(*[cell(first_bit, here) for first_bit in _bits(width) for here in range(width)])
    # The sign is taken in a step of its own, as it names its value three times.
    return F.transform(sums, _signed) if signed else sums


def subtract(a: Column, b: Column) -> Column:
    return F.transform(F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(_long(MODULUS - 1))), _signed)


def peel(cells: Column, width: int = WIDTH) -> Column:
    """The digests that a difference of sketches holds, those of the second text negative; null where peeling gets stuck or finds one twice."""
    n = ROWS * width

    def turn(state: Column, _: Column) -> Column:
        single = F.array_distinct(F.filter(F.slice(state, 1, n), lambda x: (x != 0) & is_digest(F.abs(x))))

        def rid(found: Column) -> Column:
            def less(row: int, mask: Column, at: Column) -> Column:
                def cell(x: Column, here: Column) -> Column:
                    return F.when(x == 0, x).otherwise(F.aggregate(found, x, lambda s, d: F.when(F.abs(d).bitwiseAND(mask) == here, s - d).otherwise(s)))

                return F.zip_with(F.slice(state, 1 + row * width, width), at, cell)

            left = [less(row, mask, at) for row, (mask, at) in enumerate(_rows(width))]
            return F.when(F.size(found) == 0, state).otherwise(F.concat(*left, F.slice(state, n + 1, 1 << 20), found))

        return let(single, rid)

    def end(state: Column) -> Column:
        found = F.slice(state, n + 1, 1 << 20)
        # A sum that looked like a digest is taken out again with the other sign; then the sketch counts as stuck.
        twice = F.size(F.array_distinct(F.transform(found, lambda d: F.abs(d)))) < F.size(found)
        return F.when(F.forall(F.slice(state, 1, n), lambda x: x == 0) & ~twice, found)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), cells, turn, end)


def guess(cells: Column) -> Column:
    """About how many digests a difference of sketches holds: each adds one to the expected square of one count in each row."""
    return F.aggregate(F.transform(cells, lambda x: F.round(x / (1 << ONE))), F.lit(0.0), lambda s, n: s + n * n) / ROWS


def _split(parts: Column, level: int) -> Column:
    """The parts split by two further bits, without empty ones."""
    first_bit = SPLIT_FROM + 2 * level

    def part(p: Column, i: int) -> Column:
        return F.filter(p, lambda d: F.abs(d).bitwiseAND(_long((PARTS - 1) << first_bit)) == _long(i << first_bit))

    return F.filter(F.flatten(F.transform(parts, lambda p: F.array(*[part(p, i) for i in range(PARTS)]))), lambda p: F.size(p) > 0)


def _tried(p: Column) -> Column:
    """How many digests of a part differ, or -1; a single digest has nothing to be taken from."""
    return F.when(F.size(p) == 1, 1).otherwise(F.coalesce(F.size(peel(sketch(p, PART_WIDTH, signed=True), PART_WIDTH)), F.lit(-1)))


def differing(rows: DataFrame, pairs: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """Adds to every row, for each name, how many digests only one of two sets has.

    pairs: name -> columns of the two sets of digests and of their sketches. Each retry is made of steps of their own, so
    that rows which are done cost no more than a look.
    """
    cells, about, parts, tried = ({n: f"_{kind}_{n}" for n in pairs} for kind in ("cells", "about", "parts", "tried"))

    def first(difference: Column) -> Column:
        return F.when(guess(difference) > FULL * ROWS * WIDTH, F.lit(-1)).otherwise(F.coalesce(F.size(peel(difference)), F.lit(-1)))

    def whole(name: str) -> Column:
        """The digests of both sets as one part, if the first try got stuck."""
        a, b = pairs[name][:2]
        none = F.array().cast("array<array<long>>")
        return F.when(F.col(name) < 0, F.array(F.concat(F.col(a), F.transform(F.col(b), lambda d: -d)))).otherwise(none)

    def attempt(name: str, level: int) -> Column:
        """A count for each part; null if they look too full."""
        full = F.col(about[name]) / PARTS ** (level + 1) > PART_FULL * ROWS * PART_WIDTH
        return F.when(~full, trial[name])

    def counted(name: str) -> Column:
        return F.coalesce(F.aggregate(F.col(tried[name]), F.col(name), lambda s, n: s + F.greatest(n, F.lit(0))), F.col(name))

    def left(name: str) -> Column:
        stuck = F.filter(F.col(parts[name]), lambda p, i: F.get(F.col(tried[name]), i) < 0)
        return F.when(F.col(tried[name]).isNull(), F.col(parts[name])).otherwise(stuck)

    def exact(name: str) -> Column:
        return F.aggregate(F.col(parts[name]), F.col(name), lambda s, p: s + F.size(F.array_except(p, F.transform(p, lambda d: -d))))

    # The same expression for every level, as building it takes the driver much longer than a level takes.
    trial = {n: F.transform(F.col(parts[n]), _tried) for n in pairs}
    out = settle(rows.withColumns({cells[n]: subtract(F.col(p[2]), F.col(p[3])) for n, p in pairs.items()}))
    out = settle(out.withColumns({n: first(F.col(cells[n])) for n in pairs} | {about[n]: guess(F.col(cells[n])) for n in pairs}))
    out = settle(out.withColumns({n: F.greatest(F.col(n), F.lit(0)) for n in pairs} | {parts[n]: whole(n) for n in pairs}))
    for level in range(RETRIES):
        out = settle(out.withColumns({parts[n]: _split(F.col(parts[n]), level) for n in pairs}))
        out = settle(out.withColumns({tried[n]: attempt(n, level) for n in pairs}))
        out = settle(out.withColumns({n: counted(n) for n in pairs} | {parts[n]: left(n) for n in pairs}))
    out = settle(out.withColumns({n: exact(n) for n in pairs}))
    return out.drop(*[c for names in (cells, about, parts, tried) for c in names.values()])


def likeness(size_a: Column, size_b: Column, differ: Column) -> Column:
    both = (size_a + size_b + differ) / 2
    return F.when(both == 0, 1.0).otherwise(1 - differ / both)


def written(cells: Column, size: Column) -> Column:
    """A sketch as text: the number of digests, then each cell in hexadecimal."""
    cell = lambda x: F.lpad(F.hex(x), 16, "0")
    return F.concat_ws(":", F.hex(size.cast("long")), F.array_join(F.transform(cells, cell), ""))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: str | None = None) -> DataFrame:
    """(doc_id, text, next_text): the text of the document that follows in descending id; the first one follows the last.

    With a name for ``digest``, also the digests of both, which are computed once for each row.

    Rows of one id are ordered by text, descending; rows without an id come last. Rows are dealt into chunks of the
    order, and each chunk gets a copy of the first row of the chunk after it, so no window spans the table. Many small
    chunks meet in a partition, so that partitions are about as large.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("_chunk", order_chunk(rows, "doc_id", CHUNKS))
    firsts = sorted(rows.groupBy("_chunk").agg(F.max("doc_id").alias("first")).collect(), key=lambda r: -r["_chunk"])
    follow = [(r["_chunk"], s["_chunk"], s["first"]) for r, s in zip(firsts, [*firsts[1:], *firsts[:1]], strict=True)]
    heads = spark.createDataFrame(follow, "_to long, _from long, _first long")
    met = rows.join(F.broadcast(heads), (F.col("_chunk") == F.col("_from")) & F.col("doc_id").eqNullSafe(F.col("_first")))
    copies = met.groupBy("_to").agg(F.max("text").alias("text"))
    copies = copies.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("_to").cast("int").alias("_chunk"), F.lit(1).alias("_copy"))
    both = rows.select("doc_id", "text", F.col("_chunk").cast("int").alias("_chunk"), F.lit(0).alias("_copy")).unionByName(copies)
    order = Window.partitionBy("_chunk").orderBy("_copy", F.desc_nulls_last("doc_id"), F.desc("text"))
    led = ["text"] + ([digest] if digest else [])
    if digest:
        both = both.withColumn(digest, digests(F.col("text")))
    both = both.repartition(shuffle_width(spark), "_chunk").withColumns({f"next_{c}": F.lead(c).over(order) for c in led})
    return both.where(F.col("_copy") == 0).select("doc_id", *led, *[f"next_{c}" for c in led])


def compared(rows: DataFrame, text: str, others: dict[str, str], known: dict[str, str] | None = None) -> DataFrame:
    """Adds the fingerprint of ``text`` and, for each other column, its fingerprint ``<name>_fingerprint`` and ``near_<name>``.

    ``known`` names columns that already hold the digests of the text (``self``) or of another.
    """
    columns = {"self": text, **others}
    known = known or {}
    out = settle(rows.withColumns({f"_d_{n}": F.col(known[n]) if n in known else digests(F.col(c)) for n, c in columns.items()}))
    out = settle(out.withColumns({f"_s_{n}": sketch(F.col(f"_d_{n}")) for n in columns}))
    out = differing(out, {f"_n_{n}": ("_d_self", f"_d_{n}", "_s_self", f"_s_{n}") for n in others})
    size = {n: F.size(f"_d_{n}") for n in columns}
    added = {"fingerprint": written(F.col("_s_self"), size["self"])}
    for n in others:
        added[f"{n}_fingerprint"] = written(F.col(f"_s_{n}"), size[n])
        added[f"near_{n}"] = likeness(size["self"], size[n], F.col(f"_n_{n}"))
    return out.withColumns(added).drop(*[f"_{k}_{n}" for k in "dsn" for n in columns])
