"""Line deduplication as an exact set-similarity join, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, dropped, stored

#: Words in a token of a line, and the similarity, in percent, from which a later line is a match of an earlier one.
TOKEN, PERCENT = 5, 75
#: Counters of the token frequencies, and classes to a doubling of a count: the table is 200 KB of text, however large the input.
COUNTERS, PER_OCTAVE = 1 << 16, 8
#: Bits in the table of marks by which rows are passed over before a join: 256 KB of hexadecimal digits, however large the input.
#: Tables stay under half a region of a small driver's heap, beyond which the collector keeps them apart.
MARKS = 1 << 20
#: A token that so many entries share, beyond what its counter holds of others, is dealt over SALTS tasks.
HOT_ROWS, SALTS = 4096, 64
#: Bits of a token's hash behind its class in the order of tokens.
CLASS_SHIFT = 55


def _flat(text: Column) -> Column:
    """A text or line in lower case, all white space but line ends made spaces."""
    low = F.lower(text)
    return F.when(text.rlike("[\t\x0b\x0c\r]"), F.translate(low, "\t\x0b\x0c\r", "    ")).otherwise(low)


def _lines(df: DataFrame, flat: bool = True) -> DataFrame:
    """Every line of every text with its place: doc_id, row (a hash of the row's id and text), line_no from 0.

    A null text has no lines but one row without a line; explode_outer, since explode would have Spark infer a filter for
    which all lines are made twice.
    """
    text = _flat(F.col("text")) if flat else F.col("text")
    return df.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.posexplode_outer(F.split(text, "\n")).alias("line_no", "line"))


def line_words(line: Column) -> Column:
    """The words of a line from _lines: what spaces part."""
    parts = F.split(line, " ")
    uneven = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    return F.when(uneven | (line == ""), F.array_remove(parts, "")).otherwise(parts)


def _hashed(lines: DataFrame) -> DataFrame:
    """Add _h, the hash of each word of `line`; null without a line."""
    return lines.withColumn("_h", F.transform(line_words(F.col("line")), lambda w: F.xxhash64(w)))


def token_rows(hashed: DataFrame, size: int) -> DataFrame:
    """A row for each token: a 64-bit hash of `size` words on end, or of all words of a shorter line (null if it has none)."""
    at = hashed.select("_h", F.posexplode_outer("_h").alias("i", "w"))
    n = F.size("_h")
    at = at.filter((F.col("i") + size <= n) | ((n < size) & (F.col("i") == 0)))
    return at.select(F.when(n < size, F.xxhash64("_h")).otherwise(F.xxhash64(*[F.get("_h", F.col("i") + k) for k in range(size)])).alias("token"))


def with_tokens(hashed: DataFrame, size: int) -> DataFrame:
    """Add tokens: the distinct tokens of each line, as `token_rows` makes them, as an array."""
    n = F.size("_h")
    whole = F.slice("_h", F.lit(1), F.greatest(n - size + 1, F.lit(0)))
    long = F.transform(whole, lambda w, i: F.xxhash64(w, *[F.get("_h", i + k) for k in range(1, size)]))
    tokens = F.when(F.coalesce(n, F.lit(0)) < 1, F.array().cast("array<bigint>")).when(n < size, F.array(F.xxhash64("_h"))).otherwise(F.array_distinct(long))
    return hashed.withColumn("tokens", tokens).drop("_h")


def _classes(tokens: DataFrame) -> tuple[Column, int]:
    """For each counter how often its tokens occur in all lines, on a logarithmic scale, as an array; and the first class of
    tokens that are dealt over several tasks. Subqueries are not allowed in higher-order functions, so the table is a literal."""
    counts = tokens.groupBy(_place(F.col("token"), COUNTERS).alias("at")).count()
    value = lambda c: F.floor(PER_OCTAVE * F.log2(c + 1)).cast("string")
    rows = counts.filter("at is not null").agg(F.array_sort(F.collect_list(F.struct("at", value(F.col("count")).alias("c")))).alias("rows"), (F.sum("count") / COUNTERS).alias("mean"))
    filled = _filled("rows", "at", lambda x: F.concat(x["c"], F.lit(",")), F.lit("0,"), COUNTERS)
    found = stored(rows.select(filled.alias("classes"), value(F.lit(HOT_ROWS) + 4 * F.coalesce("mean", F.lit(0.0))).alias("hot")), "line-classes")
    row = found.first()
    dropped(found)
    return F.split(F.lit(row["classes"].rstrip(",")), ",").cast("array<smallint>"), int(row["hot"]) + 1


def _filled(rows: str, at: str, text: Callable[[Column], Column], blank: Column, size: int) -> Column:
    """The texts of an array's rows, which stand in the order of `at`, with `blank` for each number under `size` that has no row."""
    gap = lambda x, i: x[at] - F.when(i > 0, F.get(F.col(rows), i - 1)[at]).otherwise(-1) - 1
    parts = F.array_join(F.transform(rows, lambda x, i: F.concat(F.repeat(blank, gap(x, i).cast("int")), text(x))), "")
    last = F.coalesce(F.array_max(F.transform(rows, lambda x: x[at])), F.lit(-1))
    return F.concat(parts, F.repeat(blank, (F.lit(size - 1) - last).cast("int")))


def _place(h: Column, size: int) -> Column:
    return h.bitwiseAND(F.lit(size - 1).cast("long"))


def _marks(rows: DataFrame, *columns: str) -> DataFrame:
    """One row, marks: a bit at the place of each of `rows`, as hexadecimal digits; what has no bit there is surely not among them."""
    at = rows.select(_place(F.xxhash64(*columns), MARKS).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    found = words.agg(F.array_sort(F.collect_list(F.struct("w", "bits"))).alias("rows"))
    digits = _filled("rows", "w", lambda x: F.lpad(F.hex(x["bits"]), 16, "0"), F.lit("0" * 16), MARKS // 64)
    return stored(found.select(digits.cast("binary").alias("marks")), "line-marks")


def _marked(df: DataFrame, marks: DataFrame, *columns: str) -> Column:
    at = _place(F.xxhash64(*[df[c] for c in columns]), MARKS)
    c = F.ascii(F.substring(marks.scalar(), (F.floor(at / 64) * 16 + 16 - F.floor(at % 64 / 4)).cast("int"), 1).cast("string"))
    digit = c - F.when(c >= 65, 55).otherwise(48)
    return digit.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(4)]), (at % 4 + 1).cast("int"))) > 0


def _prefix(n: Column, percent: int) -> Column:
    """How many of a set's n tokens, the rarest first, hold one at least that any matching set shares."""
    return n - F.ceil(n * percent / 100).cast("int") + 1


def _line_sets(df: DataFrame, size: int, percent: int) -> tuple[DataFrame, int]:
    """Every line with its place, n (tokens), entry (hash of its token set) and rare: its prefix, rarest tokens first; and the first hot class."""
    hashed = _hashed(_lines(df))
    table, hot = _classes(token_rows(hashed, size))
    rarity = lambda t: F.shiftleft(F.get(table, t.bitwiseAND(F.lit(COUNTERS - 1).cast("long")).cast("int")).cast("long"), CLASS_SHIFT).bitwiseOR(F.shiftrightunsigned(t, 64 - CLASS_SHIFT))
    sets = with_tokens(hashed, size).withColumn("_ordered", F.sort_array(F.transform("tokens", rarity)))
    n = F.size("tokens")
    out = sets.select(
        "doc_id", "row", "line_no", n.alias("n"), F.xxhash64("_ordered", F.array_min("tokens")).alias("entry"), F.slice("_ordered", F.lit(1), _prefix(n, percent)).alias("rare"),
    )
    return stored(out, "line-sets").filter("n > 0"), hot


def _may_match(p: str, q: str, percent: int) -> Column:
    """Length and positional filter: with the shared token at pos in both orders, can enough tokens be shared for the overlap?

    Before it at most the lesser number of tokens is shared that other prefixes hold too (`before`): a set that had another
    of these tokens would have it before the shared one, thus in its prefix.
    """
    n, m = F.col(f"{p}.n"), F.col(f"{q}.n")
    in_reach = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    most = F.least(F.col(f"{p}.before"), F.col(f"{q}.before")) + F.least(n - F.col(f"{p}.pos"), m - F.col(f"{q}.pos"))
    return in_reach & (most * (100 + percent) >= (n + m) * percent)


def _verified(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The entries y of pairs (x, y) whose token sets have a Jaccard similarity of `percent` at least."""
    marks = _marks(pairs.select(F.explode(F.array("x", "y")).alias("entry")).distinct(), "entry")
    asked = tokens.filter(_marked(tokens, marks, "entry"))
    a = asked.select(F.col("entry").alias("x"), F.col("tokens").alias("_a"))
    b = asked.select(F.col("entry").alias("y"), F.col("tokens").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    both = pairs.join(a, "x").join(b, "y")
    return stored(both.filter(shared * (100 + percent) >= (F.size("_a") + F.size("_b")) * percent).select("y").distinct(), "line-matched")


def _shared_postings(lines: DataFrame, entries: DataFrame, hot: int) -> DataFrame:
    """(token, entry, n, pos, before, first, copies) of the prefixes, under tokens that several entries have.

    Of the entries that stand more than once only the first place gives postings; the others need no join. Tokens of hot
    classes are dealt by entry too, and all of them count as shared.
    """
    repeated = _marked(lines, _marks(entries.filter("copies > 1").select("entry"), "entry"), "entry")
    places = entries.select("entry", "first.row", "first.line_no")
    once = lines.filter(repeated).join(places, ["entry", "row", "line_no"]).dropDuplicates(["entry"])
    cols = ["entry", "n", "rare"]
    firsts = lines.filter(~repeated).select(*cols).unionByName(once.select(*cols))
    # n and pos in one number, since rows are many and shuffled.
    postings = firsts.select("entry", "n", F.posexplode_outer("rare").alias("pos", "token")).select("token", "entry", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("pos")).alias("np"))
    dealt = F.shiftrightunsigned("token", CLASS_SHIFT) >= hot
    postings = postings.withColumn("part", F.when(dealt, F.pmod("entry", F.lit(SALTS)).cast("int")).otherwise(F.lit(-1)))
    several = Window.partitionBy("token", "part")
    shared = postings.withColumn("m", F.count(F.lit(1)).over(several)).filter("m > 1 or part >= 0")
    split = shared.select("token", "entry", F.shiftright("np", 32).cast("int").alias("n"), F.col("np").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    before = F.row_number().over(Window.partitionBy("entry").orderBy("pos")) - 1
    return stored(split.join(entries, "entry").withColumn("before", before), "line-placed")


def _dealt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings with salt, and per token and salt the leaders: the earliest entry and that with the most copies.

    Tokens with many entries are dealt over SALTS tasks, and their leaders are there in each.
    """
    l = F.struct("first", "entry", "n", "pos", "before")  # noqa: E741
    leaders = placed.groupBy("token").agg(F.min(l).alias("early"), F.max_by(l, F.struct("copies", "entry")).alias("hub"), F.count(F.lit(1)).alias("m"))
    large = F.col("m") > HOT_ROWS
    leaders = stored(leaders.select("token", "early", "hub", large.alias("large")), "line-leaders")
    hot = leaders.filter("large").select("token", "large")
    salted = placed.join(hot, "token", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    salted = stored(salted.withColumn("salt", F.when(F.col("large"), F.pmod("entry", F.lit(SALTS)).cast("int")).otherwise(F.lit(0))), "line-salted")
    return salted, leaders


def _salts(large: str) -> Column:
    return F.explode(F.when(F.col(large), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))


def _open_pairs(placed: DataFrame, matched: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of an unmatched entry y and an earlier x that can still match by the number of rare tokens they share."""
    left = placed.join(matched.withColumnRenamed("y", "entry"), "entry", "left_anti").withColumn("salt", _salts("large"))
    earlier = F.col("p.first") < F.col("q.first")
    met = placed.alias("p").join(left.alias("q"), ["token", "salt"]).filter(earlier & _may_match("p", "q", percent))
    pairs = met.groupBy(F.col("p.entry").alias("x"), F.col("q.entry").alias("y"), F.col("p.n").alias("n"), F.col("q.n").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    # Shared tokens up to where the shorter prefix ends (in the order of tokens) are all counted; behind it only that set's others can be shared.
    n, m = F.col("n"), F.col("m")
    most = F.col("c") + F.greatest(n - _prefix(n, percent), m - _prefix(m, percent))
    return stored(pairs.filter(most * (100 + percent) >= (n + m) * percent).select("x", "y"), "line-open")


def _matched_entries(df: DataFrame, lines: DataFrame, hot: int, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(entry, first: the place where it first stands, copies) of all token sets, and the entries that match an earlier one."""
    first = F.min(F.struct("doc_id", "row", "line_no")).alias("first")
    entries = stored(lines.groupBy("entry").agg(first, F.count(F.lit(1)).alias("copies")), "line-entries")
    shared = _shared_postings(lines, entries, hot)
    places = shared.select("entry", "first.row", "first.line_no").distinct()
    texts = _lines(df, flat=False)
    texts = texts.filter(_marked(texts, _marks(places, "row", "line_no"), "row", "line_no")).join(places, ["row", "line_no"]).dropDuplicates(["entry"])
    tokens = stored(with_tokens(_hashed(texts.select("entry", _flat(F.col("line")).alias("line"))), size).select("entry", "tokens"), "line-tokens")

    placed, leaders = _dealt(shared)
    dropped(shared)
    led = leaders.select("token", "large", F.explode(F.array("early", "hub")).alias("l")).select("token", "large", "l.*").distinct().withColumn("salt", _salts("large")).alias("p")
    tried = placed.alias("q").join(led, ["token", "salt"]).filter((F.col("p.first") < F.col("q.first")) & _may_match("p", "q", percent))
    tried = stored(tried.select(F.col("p.entry").alias("x"), F.col("q.entry").alias("y")).distinct(), "line-tried")
    matched = _verified(tried, tokens, percent)
    # What no leader matches is held against every earlier entry under its tokens.
    others = _open_pairs(placed, matched, percent)
    found = stored(matched.unionByName(_verified(others, tokens, percent)).distinct(), "line-near")
    dropped(tokens, placed, leaders, tried, others, matched)
    return entries, found


def removed_lines(df: DataFrame, size: int = TOKEN, percent: int = PERCENT) -> DataFrame:
    """row and lines (array of line numbers): the lines of each row that match an earlier line.

    Two lines match if the Jaccard similarity of their token sets is at least `percent`; earlier is by doc_id (null
    first), the row's hash and the line number, and whether the earlier line is itself removed does not matter. Equal sets are one
    entry with its first place, so a line that stands everywhere costs no pairs. Entries meet under their rarest tokens
    (prefix filter), by classes of frequency over all lines and then by hash; what the length and positional filters
    leave is verified on the whole sets: first against two leaders of each token, the earliest entry and the one with
    the most copies, then, if no leader matches, against every earlier entry.
    """
    lines, hot = _line_sets(df, size, percent)
    entries, near = _matched_entries(df, lines, hot, size, percent)
    judged = entries.join(near.select(F.col("y").alias("entry"), F.lit(True).alias("near")), "entry", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    place = F.struct("doc_id", "row", "line_no")
    # An entry that stands once and matches nothing removes no line; the others are far fewer than the lines. A join that
    # Spark can split where a line stands everywhere: nothing is grouped by entry.
    again = judged.filter((F.col("copies") > 1) | F.col("near")).select("entry", "first", "near")
    gone = lines.select("doc_id", "row", "line_no", "entry").join(again, "entry").filter(F.col("near") | (place != F.col("first")))
    out = stored(gone.groupBy("row").agg(F.collect_set("line_no").alias("lines")), "line-removed")
    dropped(lines, entries, near)
    return out


def dedup_lines(df: DataFrame, size: int = TOKEN, percent: int = PERCENT, names: tuple[str, str | None, str | None] = ("kept", "n_lines", "n_removed")) -> DataFrame:
    """`df` with the text without its removed lines, the number of lines and of removed lines under `names`, in place of text.

    Lines without words always stay. A null text has no lines and stays null; an empty text is one line without words.
    Rows that repeat in doc_id and text are one row to the comparison and lose the same lines. An empty table gives
    none. Other columns are carried, but for those named like one of `names`, which are replaced; a name of None leaves
    that column out. A text is split in one task, which holds its lines. Texts without removed lines are not shuffled.
    """
    gone = removed_lines(df, size, percent)
    marks = _marks(gone.select("row"), "row")
    cols = [c for c in df.columns if c != "text" and c not in names]
    held = df.select(F.struct(F.lit(0).alias("_"), *[df[c] for c in cols]).alias("_held"), F.col("text").alias("_text"), F.xxhash64("doc_id", "text").alias("row"))
    marked = _marked(held, marks, "row")
    none = F.array().cast("array<int>")
    parts = [held.filter(marked).join(gone, "row", "left"), held.filter(~marked).withColumn("lines", F.lit(None).cast("array<int>"))]
    both = parts[0].unionByName(parts[1]).withColumn("lines", F.coalesce("lines", none))
    both, split = both.withColumn("_split", F.split("_text", "\n")), F.col("_split")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("lines"))
    kept = F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")
    values = (
        F.when(F.size("lines") == 0, F.col("_text")).otherwise(kept), F.when(F.col("_text").isNull(), 0).otherwise(F.size(split)).cast("long"), F.size("lines").cast("long"),
    )
    return both.select(*[F.col("_held")[c].alias(c) for c in cols], *[v.alias(n) for v, n in zip(values, names, strict=True) if n])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that match an earlier line, as counts and digests."""
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS line_no, unnest(lines) AS line FROM d),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM l),
t AS (
  SELECT doc_id, line_no,
         CASE WHEN len(words) < 5 THEN [words] ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])) END AS tokens
  FROM w WHERE len(words) > 0),
e AS (SELECT list_sort(tokens) AS tokens, min(struct_pack(d := doc_id, n := line_no)) AS first FROM t GROUP BY 1),
n AS (SELECT row_number() OVER (ORDER BY first) AS e, tokens, first, len(tokens) AS n FROM e),
p AS (SELECT e, n, unnest(tokens) AS token FROM n),
m AS (
  SELECT y.e FROM p x JOIN p y ON x.token = y.token AND x.e < y.e AND least(x.n, y.n) * 100 >= greatest(x.n, y.n) * 75
  GROUP BY x.e, x.n, y.e, y.n HAVING count(*) * 175 >= (x.n + y.n) * 75),
g AS (
  SELECT t.doc_id, t.line_no FROM t JOIN n ON list_sort(t.tokens) = n.tokens
  WHERE n.e IN (SELECT e FROM m) OR struct_pack(d := t.doc_id, n := t.line_no) <> n.first),
k AS (
  SELECT l.doc_id, count(*) FILTER (WHERE g.line_no IS NOT NULL) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE g.line_no IS NULL), '') AS kept
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line_no = g.line_no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(d.lines), 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
