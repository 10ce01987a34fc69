"""Fingerprints of documents as invertible Bloom lookup sketches, in SQL functions alone.

1. Paragraphs: a text is cut behind every line break or sentence mark, and a longer stretch every MOST characters. Each
   distinct paragraph has a digest: 48 bits of its hash and, in the low 16 bits, its length. Repeats count once.
2. Sketch: TABLES tables of WIDTH cells. A digest goes to one cell of each; a cell keeps how many it has, and the
   exclusive or of their digests and of their checks. The fingerprint is the sketch of the whole text, with the number
   of its paragraphs and a hash of the text; texts that are equal, and only those, have equal fingerprints.
3. Difference: cells of two versions subtract. A cell that holds one digest, by count and check, gives it up, and it is
   taken from its other cells, until the sketch is empty (then all differing digests are known) or no cell is left.
4. Retry: if it doesn't come empty, the digests are dealt to FAN sketches, FAN times larger together, and those that
   fail again to FAN each, LEVELS times. What fails even then (two digests that share all cells LEVELS times) is compared
   directly. Work is in proportion to the paragraphs and the levels, whatever the length of a text.
5. Likeness: characters of the paragraphs in both versions, by those in either.

The next document is found by ranges of doc_id: bounds are ids of rows (approximate quantiles of the column), a range's
rows meet once, and the rows at a bound go to the range before, too, so that its last row finds its successor. Texts are
shuffled once. A range is sorted with spill, never held.

Null text counts as empty; an empty text has no paragraphs, and two of them are alike (1). Documents are ordered by
doc_id (an integer; nulls first), rows that share an id by length and text, so each of repeated rows but the last has its
copy as the next. A single document is its own successor. Rows that share one id meet in one task. Other columns of docs
aren't read; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TABLES, WIDTH, FAN, LEVELS = 3, 8, 8, 12
MOST = 120
RANGE_BYTES, RANGES = 64 << 20, 100_000
PARAGRAPH = rf"[^.!?\n]{{1,{MOST}}}[.!?\n]*|[.!?\n]+"
_BITS = 3  # of WIDTH, and of FAN
_CELLS = f"array({', '.join(map(str, range(TABLES * WIDTH)))})"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def digests(text: str) -> str:
    """Distinct digests of a text's paragraphs."""
    pieces = f"regexp_extract_all({text}, r'{PARAGRAPH}', 0)"
    return f"array_distinct(transform({pieces}, p -> (xxhash64(p) & ~65535L) | least(char_length(p), 65535)))"


def placed(items: str, level: int | str) -> str:
    """Items (digest d, sign n) with what a level makes of their hash: at, a bit for each of its cells; child, its smaller sketch; chk, the check."""
    bit = lambda t: f"shiftleft(1, {WIDTH * t} + cast(shiftright(e.h, {_BITS * t}) & {WIDTH - 1} as int))"
    made = f"named_struct('d', e.d, 'n', e.n, 'at', {' | '.join(map(bit, range(TABLES)))}, 'child', shiftright(e.h, {_BITS * TABLES}) & {FAN - 1}, 'chk', shiftrightunsigned(e.h, 32))"
    return f"transform(transform({items}, x -> named_struct('d', x.d, 'n', x.n, 'h', xxhash64(x.d, {level}))), e -> {made})"


def hashed(own: str, level: int | str) -> str:
    return placed(f"transform({own}, d -> named_struct('d', d, 'n', 1))", level)


def cells(items: str) -> str:
    """The sketch of placed items: WIDTH cells of the first table, then of the next."""
    one = "(a, e) -> named_struct('n', a.n + e.n, 'key', a.key ^ e.d, 'chk', a.chk ^ e.chk)"
    return f"transform({_CELLS}, i -> aggregate(filter({items}, e -> getbit(e.at, i) = 1), named_struct('n', 0, 'key', 0L, 'chk', 0L), {one}))"


def subtracted(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (x, y) -> named_struct('n', x.n - y.n, 'key', x.key ^ y.key, 'chk', x.chk ^ y.chk))"


def peeled(difference: str, level: int | str) -> str:
    """cells: what is left of the difference; found: differing digests; more: whether the last round found any."""
    single = f"filter(s.cells, c -> (c.n = 1 OR c.n = -1) AND shiftrightunsigned(xxhash64(c.key, {level}), 32) = c.chk)"
    pure = placed(f"array_distinct(transform({single}, c -> named_struct('d', c.key, 'n', c.n)))", level)
    less = "(a, e) -> named_struct('n', a.n - e.n, 'key', a.key ^ e.d, 'chk', a.chk ^ e.chk)"
    after = f"named_struct('cells', transform(s.cells, (c, i) -> aggregate(filter(p, e -> getbit(e.at, i) = 1), c, {less})), 'found', concat(s.found, transform(p, e -> e.d)), 'more', true)"
    stop = "named_struct('cells', s.cells, 'found', s.found, 'more', false)"
    start = f"named_struct('cells', {difference}, 'found', cast(array() as array<bigint>), 'more', true)"
    return f"aggregate(sequence(1, {TABLES * WIDTH}), {start}, (s, k) -> if(s.more, {_let(pure, 'p', f'if(size(p) > 0, {after}, {stop})')}, s))"


def _size(found: str) -> str:
    return f"aggregate({found}, 0L, (a, d) -> a + (d & 65535))"


def differing(todo: str) -> str:
    """Characters of the paragraphs that two versions don't share, by which (0 or 1).

    todo: array of which, items (placed digests of both, those of the second with sign -1), diff (their sketches' difference), all at level 0.
    In larger sketches the second version's digests are taken from the first's cells one by one, which is the same difference."""
    tried = f"transform(t.todo, x -> {_let(peeled('x.diff', 'v'), 'r', 'struct(x.which, x.items, r.found, forall(r.cells, c -> c.n = 0 AND c.key = 0 AND c.chk = 0) AS ok)')})"
    smaller = f"transform(sequence(0, {FAN - 1}), f -> struct(x.which, {placed('filter(x.items, e -> e.child = f)', 'v + 1')} AS items))"
    again = f"flatten(transform(filter(done, x -> NOT x.ok), x -> {smaller}))"
    larger = f"transform({again}, x -> struct(x.which, x.items, {cells('x.items')} AS diff))"
    summed = lambda w: f"t.n{w} + aggregate(filter(done, x -> x.ok AND x.which = {w}), 0L, (n, x) -> n + {_size('x.found')})"
    after = _let(tried, "done", f"named_struct('todo', {larger}, 'n0', {summed(0)}, 'n1', {summed(1)})")
    of = lambda sign: f"transform(filter(x.items, e -> e.n = {sign}), e -> e.d)"
    apart = f"{_size(f'array_except({of(1)}, {of(-1)})')} + {_size(f'array_except({of(-1)}, {of(1)})')}"
    last = lambda w: f"t.n{w} + aggregate(filter(t.todo, x -> x.which = {w}), 0L, (n, x) -> n + {apart})"
    return f"aggregate(sequence(0, {LEVELS - 1}), named_struct('todo', {todo}, 'n0', 0L, 'n1', 0L), (t, v) -> if(size(t.todo) > 0, {after}, t), t -> array({last(0)}, {last(1)}))"


def likeness(left: str, right: str, differ: str) -> str:
    """Characters in both by those in either, of sums of characters of two versions and of what differs."""
    return f"if({left} + {right} = 0, 1D, ({left} + {right} - {differ}) / double({left} + {right} + {differ}))"


def printed(sketch: str, own: str, text: str) -> str:
    row = "concat_ws(':', hex(c.n), hex(c.key), hex(c.chk))"
    return f"concat_ws('.', size({own}), hex(xxhash64({text})), array_join(transform({sketch}, c -> {row}), ','))"


def _part(bounds: list[int]) -> str:
    """The number of the last bound that isn't above doc_id, found by bisection; 0 for a null id."""
    steps = max(len(bounds) - 1, 0).bit_length()
    at = f"a + shiftleft(1, {steps} - k)"
    search = f"aggregate(sequence(1, {steps}), 0, (a, k) -> if({at} < {len(bounds)} AND bounds[{at}] <= doc_id, {at}, a))" if steps else "0"
    return f"if(doc_id is null, 0, {search})"


def _with_bounds(docs: DataFrame, bounds: list[int]) -> DataFrame:
    known = f"array({', '.join(f'{b}L' if b > -(1 << 63) else 'bigint(-9223372036854775807L - 1)' for b in bounds) or '0L'})"
    return docs.withColumn("bounds", F.expr(known)).withColumn("part", F.expr(_part(bounds)))


def _bounds(docs: DataFrame, least: int) -> tuple[list[int], bool]:
    """First ids of about equal ranges, in order, and whether an id is null. Quantiles are approximate, and as doubles; so each range's own least id is looked up."""
    n, size, low, none = docs.agg(F.count("doc_id"), F.sum(F.octet_length("text")), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = min(max(least, (size or 0) // RANGE_BYTES), RANGES, n)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * max(ranges, 500))).first()[0] if ranges > 1 else []
    rough = sorted({*([] if low is None else [low]), *(c for c in cuts or [] if c > low)})
    if len(rough) < 2:
        return rough, none > 0
    first = _with_bounds(docs.where("doc_id is not null").select("doc_id"), rough).groupBy("part").agg(F.min("doc_id")).collect()  # a row a range
    return sorted(r[1] for r in first), none > 0


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, own (hashed digests of level 0), own_cells (their sketch), and the same of the next document: next_text, next_own, next_own_cells."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds, none = _bounds(docs, 4 * parts)
    x = _with_bounds(docs, bounds)
    first = F.col("doc_id").isNull() if none else F.col("doc_id") == F.expr("bounds[0]")
    place = lambda part, copy: F.struct(part.alias("part"), F.lit(copy).alias("copy"))
    own = place(F.col("part"), False)
    again = F.when(first, F.array(own, place(F.lit(max(len(bounds) - 1, 0)), True))).when((F.expr("bounds[part]") == F.col("doc_id")) & (F.col("part") > 0), F.array(own, place(F.col("part") - 1, True)))
    x = x.select("doc_id", "text", F.explode(F.coalesce(again, F.array(own))).alias("place")).select("doc_id", "text", "place.*")
    x = x.repartition(parts, "part").withColumn("own", F.expr(hashed(digests("text"), 0))).withColumn("own_cells", F.expr(cells("own")))
    order = Window.partitionBy("part").orderBy("copy", F.col("doc_id").asc_nulls_first(), F.char_length("text"), "text")
    after = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "own", "own_cells")]
    return x.select("doc_id", "text", "own", "own_cells", "copy", *after).where("NOT copy").drop("copy")


def fingerprinted(pairs: DataFrame) -> DataFrame:
    """Fingerprints of the versions text and edited, and likenesses. pairs: the columns of with_next(), and edited."""
    x = pairs.withColumn("edited_own", F.expr(hashed(digests("edited"), 0))).withColumn("edited_own_cells", F.expr(cells("edited_own")))
    x = x.withColumns({f"{c}_size": F.expr(f"aggregate({c}, 0L, (a, e) -> a + (e.d & 65535))") for c in ("own", "edited_own", "next_own")})
    less = lambda c: f"transform({c}, e -> named_struct('d', e.d, 'n', -1, 'at', e.at, 'child', e.child, 'chk', e.chk))"
    item = lambda w, c: f"named_struct('which', {w}, 'items', concat(own, {less(c)}), 'diff', {subtracted('own_cells', f'{c}_cells')})"
    x = x.withColumn("todo", F.expr(f"array({item(0, 'edited_own')}, {item(1, 'next_own')})")).withColumn("differ", F.expr(differing("todo")))
    return x.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(printed("own_cells", "own", "text")).alias("fingerprint"),
        F.expr(printed("edited_own_cells", "edited_own", "edited")).alias("edited_fingerprint"),
        F.expr(likeness("own_size", "edited_own_size", "differ[0]")).alias("near_edited"),
        F.expr(likeness("own_size", "next_own_size", "differ[1]")).alias("near_next"),
    )


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, and that of its text with the last quarter replaced by the start of the next document's."""
    quarter = "char_length(text) div 4"
    edited = f"concat(left(text, cast(char_length(text) - {quarter} as int)), left(next_text, cast({quarter} as int)))"
    return fingerprinted(with_next(docs).withColumn("edited", F.expr(edited)))
