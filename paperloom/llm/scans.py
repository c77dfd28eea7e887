"""Problem 6: noise in text from scanned pages.

Method:
* Misread characters. Every word of the collection is reduced to the skeleton of
  its glyphs (characters and pairs that scanners confuse share one); words of one
  skeleton form a group. The right form of a group has no
  digit or mark and is the most frequent, unless another stands in ``RATIO`` times as
  many contexts (pairs of neighbouring words, each counted once, however often it is
  copied). Another form is a misread of it if they share a neighbour and it is at most
  1/``RATIO`` as frequent, in words or in contexts; if the right form stands in all its
  contexts and in twice as many; or if it holds a digit or mark and shares a whole
  context. Codes (two digits in a row, a letter or two with a digit) take no part,
  nor do halves of words split at a line end.
* Page furniture. A line of its own that is a printed page number is one; header
  lines have the shape of one (capitals alone, or two titled halves set apart by a
  dash, a bar or a gap, of at most ``HEADER_WORDS`` words) and cut a sentence, name
  what the text itself names or, with digits masked, have a half that other records
  repeat.
* Split words. With furniture set aside, a line that ends in a hyphen and goes on
  in small letters splits a word, unless the collection writes the hyphenated
  form and not the joined one.
* Reflow. Lines become paragraphs through SQL windows over their order.

The table of misreads is broadcast only if it has at most ``BROADCAST_WORDS``
rows; beyond that it is joined by shuffle, with the same result.

Defined cases: JSON that cannot be read, other block types, null and empty text
have no noise; copies of rows count once; a text is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.sources.tables import read_table, shared_checkpoint

RATIO = 10
BROADCAST_WORDS = 100_000
#: What a page header is here: a line of at most so many words, however long they are.
HEADER_WORDS = 14

# Glyphs that scanners confuse, applied in this order.
SINGLE = ("0159!†", "olsgit")
PAIRS = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("li", "h"), ("mi", "nn"))
MERGED = ("eh", "cb")

PAGE_NUMBER = re.compile(
    r"^\s*(?:[-–—]\s*\d{1,4}\s*[-–—]|(?:p|pg|pp|s)\.\s*\d{1,4}|(?:page|seite|página|pagina|pag\.|pág\.)\s+\d{1,4}(?:\s*(?:of|von|de|sur|/)\s*\d{1,4})?"
    r"|\[\s*\d{1,4}\s*\]|[A-Z]-\d{1,4}|\d{1,4}(?:\s*/\s*\d{1,4})?)\s*$",
    re.I,
)
_TITLED = r"[^\W\d_a-zäöüßàâçéèêëîïôûùñáíóú][^|]*?"
_HALVES = re.compile(rf"^\s*({_TITLED})(?:\s+[-–—|]\s+|\s{{3,}})({_TITLED})\s*$")
_END = re.compile(r"[.,;:!?]\s*$")
_SPLIT_END = re.compile(r"([^\W\d_]+)[-‐\xad][ \t]*$")
_GOES_ON = re.compile(r"^\s*([^\W\d_]+)")

WORD = r"!?[\p{L}\p{Nd}†]+(?:!+[\p{L}\p{Nd}†]+)*!?"
#: Words around a hyphen at a line end are halves, not words.
_HALF_WORDS = r"\p{L}+[-‐­][ \t]*\n\s*\p{L}*"


def skeleton(word: Column) -> Column:
    out = F.translate(word, *SINGLE)
    for pair, one in PAIRS:
        out = F.replace(out, F.lit(pair), F.lit(one))
    return F.translate(out, *MERGED)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.regexp_replace(text, _HALF_WORDS, " ")), F.lit(f"({WORD})"), F.lit(1))


def is_word(word: Column) -> Column:
    return (F.length(word) >= 3) & ~word.rlike(r"\p{Nd}\p{Nd}|^(?:fy|q)\d|^\p{Nd}\p{L}$|^\p{L}\p{Nd}\p{L}?$|^\p{Nd}+$|^\p{L}{3,}\p{Nd}$|\p{Nd}\p{L}\p{Nd}") | (
        word.rlike(r"^\p{L}{2,}[0159]$") & (F.length(word) >= 4)
    )


def vocabulary(records: DataFrame) -> DataFrame:
    """``word, n``: every word of the collection, partially counted before its shuffle."""
    # An inner explode would have the words computed once more, to drop texts without any before their copies go.
    return records.select(F.explode_outer(words_of(F.col("text"))).alias("word")).filter(F.length("word") >= 3).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def candidate_forms(words: DataFrame) -> DataFrame:
    """``word, n, bone`` of words whose skeleton has two forms or more."""
    known = words.filter(is_word(F.col("word"))).withColumn("bone", skeleton(F.col("word")))
    return known.join(known.groupBy("bone").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("bone"), "bone")


def contexts(records: DataFrame, forms: DataFrame) -> DataFrame:
    """``bone, word, l, r``: every pair of neighbours in which a form stands, once however often it is copied."""

    def beside(w: Column) -> Column:
        # A misread neighbour is the same neighbour, and so is another number.
        return F.when(w.rlike(r"^\p{Nd}+$"), "0").otherwise(skeleton(F.coalesce(w, F.lit(""))))

    ws = records.select(words_of(F.col("text")).alias("ws"))
    placed = F.transform("ws", lambda w, i: F.struct(w.alias("word"), F.get("ws", i - 1).alias("l"), F.get("ws", i + 1).alias("r")))
    rows = ws.select(F.explode(placed).alias("p")).select("p.*").filter(F.length("word") >= 3)
    met = rows.join(_fit_to_broadcast(forms.select("word", "bone")), "word").distinct()
    return met.select("bone", "word", beside(F.col("l")).alias("l"), beside(F.col("r")).alias("r")).distinct()


def misread_forms(words: DataFrame, ratio: int = RATIO, records: DataFrame | None = None) -> DataFrame:
    """``word, correct``: forms of a skeleton that its best form explains; by frequency alone where no ``records`` give contexts."""
    marked = r"[\p{Nd}!†]"
    if records is None:
        known = words.filter(is_word(F.col("word"))).withColumn("bone", skeleton(F.col("word")))
        best = known.groupBy("bone").agg(F.max(F.struct("n", "word")).alias("best"), F.count(F.lit(1)).alias("forms")).filter("forms > 1")
        both = known.join(best, "bone").filter((F.col("n") * ratio <= F.col("best.n")) & ~F.col("best.word").rlike(marked))
        return both.select("word", F.col("best.word").alias("correct"))
    forms = shared_checkpoint(candidate_forms(words))
    stands = shared_checkpoint(contexts(records, forms))
    sizes = forms.join(stands.groupBy("bone", "word").agg(F.count(F.lit(1)).alias("places")), ["bone", "word"])
    # The frequent form, unless it is copied: another that stands in ``ratio`` times as many contexts is the right one.
    first, rival = (F.struct(*(F.col(f"{side}.{c}").alias(c) for c in ("n", "places", "word"))) for side in ("by_n", "by_places"))
    ranked = sizes.filter(~F.col("word").rlike(marked)).groupBy("bone").agg(
        F.max(F.struct("n", "places", "word")).alias("by_n"), F.max(F.struct("places", "n", "word")).alias("by_places")
    )
    best = ranked.select("bone", F.when(F.col("by_places.places") >= F.col("by_n.places") * ratio, rival).otherwise(first).alias("best"))
    best = shared_checkpoint(best)
    right = stands.join(best.select("bone", F.col("best.word").alias("word")), ["bone", "word"])
    lefts = right.select("bone", "l").distinct().withColumn("on_left", F.lit(True))
    rights = right.select("bone", "r").distinct().withColumn("on_right", F.lit(True))
    whole = right.select("bone", "l", "r").withColumn("on_both", F.lit(True))
    met = stands.join(lefts, ["bone", "l"], "left").join(rights, ["bone", "r"], "left").join(whole, ["bone", "l", "r"], "left")
    shared = met.groupBy("bone", "word").agg(
        F.count_if(F.col("on_left") | F.col("on_right")).alias("near"), F.count_if("on_both").alias("same")
    ).filter("near > 0")
    both = sizes.join(best, "bone").filter(F.col("word") != F.col("best.word")).join(shared, ["bone", "word"])
    rare = (F.col("n") * ratio <= F.col("best.n")) | (F.col("places") * ratio <= F.col("best.places"))
    covered = (F.col("same") == F.col("places")) & (F.col("places") * 2 <= F.col("best.places"))
    given = F.col("word").rlike(marked) & (F.col("same") > 0)
    return both.filter(rare | covered | given).select("word", F.col("best.word").alias("correct"))


def _fit_to_broadcast(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_WORDS else table


def misreads(records: DataFrame, forms: DataFrame) -> DataFrame:
    """``table_name, record_id, word, correct`` of each record and misread form."""
    rows = records.select("table_name", "record_id", F.explode_outer(F.array_distinct(words_of(F.col("text")))).alias("word"))
    return rows.filter(F.length("word") >= 3).join(_fit_to_broadcast(forms), "word")


def _mask(half: str) -> str:
    return re.sub(r"\d+", "9", " ".join(half.lower().split()))


def header_halves(line: str) -> list[str] | None:
    """Masked halves of a line in the shape of a page header, else None."""
    text = line.strip()
    if len(text) < 4 or len(text.split()) > HEADER_WORDS or _END.search(text) or not text[0].isalpha() or PAGE_NUMBER.match(text):
        return None
    letters = [c for c in text if c.isalpha()]
    m = _HALVES.match(line)
    if m:
        a, b = m.group(1).strip(), m.group(2).strip()
        lower = sum(w[0].islower() for half in (a, b) for w in half.split() if w[0].isalpha())
        if lower <= 3 and len(a) > 2 and len(b) > 2:
            return [_mask(a), _mask(b)]
    if len(text.split()) >= 2 and sum(c.isupper() for c in letters) == len(letters) and len(letters) >= 6 and not re.search(r"\d[.,]\d|[$£€₹%]", text):
        return [_mask(text)]
    return None


def _names(halves: list[str], lines: list[str], at: int) -> bool:
    """Whether a half of two words or more stands in another line of the text."""
    rest = "\n".join(_mask(line) for k, line in enumerate(lines) if k != at)
    return any(" " in half and half in rest for half in halves)


def furniture(text: str) -> tuple[list[str], list[tuple[int, str]], list[tuple[int, list[str], bool]], list[tuple[int, str, str]]]:
    """Lines, page numbers, header candidates (line, halves, whether the text alone shows it) and split words (line, first half, second half)."""
    lines = text.split("\n")
    capitals = sum(1 for s in lines if s.strip() and s.upper() == s and any(c.isalpha() for c in s))
    numbers, headers = [], []
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        if PAGE_NUMBER.match(line):
            numbers.append((i, line.strip()))
        elif (halves := header_halves(line)) and (len(halves) > 1 or capitals <= max(1, len(lines) // 4)):
            last = next((s for s in reversed(lines[:i]) if s.strip() and not PAGE_NUMBER.match(s)), "")
            # A line that cuts a sentence, or opens or closes the text, needs no other record to repeat it.
            cuts = not last or not _END.search(last) or not any(s.strip() for s in lines[i + 1 :])
            headers.append((i, halves, cuts or len(halves) > 1 and _names(halves, lines, i)))
    aside = {i for i, _ in numbers} | {i for i, *_ in headers}
    body = [i for i, line in enumerate(lines) if line.strip() and i not in aside]
    splits = []
    for i, k in zip(body, body[1:]):
        a, b = _SPLIT_END.search(lines[i]), _GOES_ON.match(lines[k])
        if a and b and (b.group(1)[0].islower() or b.group(1).isupper() and a.group(1).isupper()):
            splits.append((i, a.group(1), b.group(1)))
    return lines, numbers, headers, splits


_LAYOUT = "table_name string, record_id string, at int, noise string, masks array<string>, shown boolean, joined string, hyphenated string"


def layout(records: DataFrame) -> DataFrame:
    """One row a page number, header candidate or split word."""

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["table_name", "record_id", "at", "noise", "masks", "shown", "joined", "hyphenated"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string()]
        for frame in frames:
            rows = []
            for table, record, text in zip(*(c.to_pylist() for c in frame.columns)):
                _, numbers, headers, splits = furniture(text)
                rows += [(table, record, i, "page_number", None, None, None, None) for i, _ in numbers]
                rows += [(table, record, i, "running_header", halves, shown, None, None) for i, halves, shown in headers]
                rows += [(table, record, i, "hyphenation", None, None, (a + b).lower(), f"{a}-{b}".lower()) for i, a, b in splits]
            columns = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    # One line of more words than a header has holds no furniture.
    few = F.size(F.split(F.trim("text"), r"\s+")) <= HEADER_WORDS
    return records.filter(F.col("text").contains("\n") | few).mapInArrow(batches, _LAYOUT)


def confirmed_headers(found: DataFrame) -> DataFrame:
    """Candidates that their own text shows, or of which another record repeats a masked half."""
    candidates = found.filter("noise = 'running_header'")
    halves = candidates.select("table_name", "record_id", "at", "shown", F.explode("masks").alias("mask"))
    once = halves.select("table_name", "record_id", "mask").distinct()
    repeated = once.groupBy("mask").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("mask")
    key = ["table_name", "record_id", "at"]
    others = halves.filter("not shown").join(repeated, "mask", "left_semi").select(*key).distinct()
    return candidates.filter("shown").select(*key).unionByName(others)


def confirmed_splits(found: DataFrame, records: DataFrame, words: DataFrame) -> DataFrame:
    """Split words, without compounds that the collection writes with a hyphen."""
    splits = found.filter("noise = 'hyphenation'").select("table_name", "record_id", "at", "joined", "hyphenated")
    compound = records.filter(F.col("text").contains("-")).select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+-\p{L}+)"), F.lit(1))).alias("hyphenated")
    ).groupBy("hyphenated").agg(F.count(F.lit(1)).alias("apart"))
    joined = words.select(F.col("word").alias("joined"), F.col("n").alias("together"))
    both = splits.join(compound, "hyphenated", "left").join(joined, "joined", "left")
    return both.filter(F.coalesce("apart", F.lit(0)) <= F.coalesce("together", F.lit(0))).select("table_name", "record_id", "at")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """``table_name, record_id, text`` of section chunks and of readable paragraph and list blocks."""
    chunks = read_table(spark, folder, "chunks", "chunk_id", "kind", "text").filter("kind = 'section' and text is not null")
    chunks = chunks.select(F.lit("chunks").alias("table_name"), F.col("chunk_id").alias("record_id"), "text")
    blocks = read_table(spark, folder, "blocks", "block_id", "json")
    parsed = blocks.select("block_id", F.from_json("json", "type string, content string, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    parsed = parsed.filter("j._bad is null and j.type in ('paragraph', 'list') and j.content is not null")
    parsed = parsed.select(F.lit("blocks").alias("table_name"), F.col("block_id").alias("record_id"), F.col("j.content").alias("text"))
    return chunks.unionByName(parsed).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    # Read, parsed and freed of copies once; four steps use it.
    rows = shared_checkpoint(records(spark, folder))
    words = shared_checkpoint(vocabulary(rows))
    forms = shared_checkpoint(misread_forms(words, records=rows))
    found = shared_checkpoint(layout(rows))
    wrong = misreads(rows, forms).select("table_name", "record_id", F.lit("misread").alias("noise"))
    numbers = found.filter("noise = 'page_number'").select("table_name", "record_id", "noise")
    headers = confirmed_headers(found).select("table_name", "record_id", F.lit("running_header").alias("noise"))
    splits = confirmed_splits(found, rows, words).select("table_name", "record_id", F.lit("hyphenation").alias("noise"))
    return wrong.unionByName(numbers).unionByName(headers).unionByName(splits).distinct()


def p6_text(spark: SparkSession, folder: str) -> DataFrame:
    """``table_name, record_id, clean_text``: repaired and reflowed text of every record."""
    # Read, parsed and freed of copies once; four steps use it.
    rows = shared_checkpoint(records(spark, folder))
    words = shared_checkpoint(vocabulary(rows))
    forms = shared_checkpoint(misread_forms(words, records=rows))
    found = shared_checkpoint(layout(rows))
    key = ["table_name", "record_id"]
    aside = found.filter("noise = 'page_number'").select(*key, "at").unionByName(confirmed_headers(found)).withColumn("aside", F.lit(True))
    split = confirmed_splits(found, rows, words).withColumn("split", F.lit(True))
    lines = rows.select(*key, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.join(aside, [*key, "at"], "left").join(split, [*key, "at"], "left").filter("aside is null")
    order = Window.partitionBy(*key).orderBy("at")
    before, blank = F.lag("line").over(order), F.trim("line") == ""
    full = F.avg(F.length("line")).over(Window.partitionBy(*key))
    # A paragraph begins after a blank line, and after a sentence that ended on a short line.
    starts = before.isNull() | (F.trim(before) == "") | (before.rlike(r"[.!?:]\s*$") & (F.length(before) < full * 0.8))
    lines = lines.withColumn("starts", starts).filter(~blank)
    lines = lines.withColumn("joined", F.coalesce(F.lag("split").over(order), F.lit(False)))
    # Blank lines and furniture between the halves of a word start nothing.
    lines = lines.withColumn("starts", (F.col("starts") & ~F.col("joined")).cast("int"))
    lines = lines.withColumn("paragraph", F.sum("starts").over(order))
    trimmed = F.when(F.col("split"), F.regexp_replace(F.rtrim("line"), r"[-‐­]$", "")).otherwise(F.rtrim("line"))
    piece = F.concat(F.when((F.col("starts") == 1) | F.col("joined"), "").otherwise(" "), F.ltrim(trimmed))
    joined = lines.groupBy(*key, "paragraph").agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("p")))).alias("ps"))
    joined = joined.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("paragraph", F.array_join("ps.p", "").alias("t")))).alias("ts"))
    text = joined.select(*key, F.array_join("ts.t", "\n\n").alias("flat"))
    wrong = misreads(rows, forms).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("word", "correct")), asc=False).alias("wrong"))
    text = rows.select(*key).join(text, key, "left").join(wrong, key, "left")

    def put_right(acc: Column, w: Column) -> Column:
        titled = F.concat(F.upper(F.substring(w["correct"], 1, 1)), F.substring(w["correct"], 2, 1000))
        quoted = F.concat(F.lit(r"(?<![\p{L}\p{Nd}])\Q"), w["word"], F.lit(r"\E(?![\p{L}\p{Nd}])"))
        first = F.concat(F.upper(F.substring(w["word"], 1, 1)), F.substring(w["word"], 2, 1000))
        high = F.concat(F.lit(r"(?<![\p{L}\p{Nd}])\Q"), first, F.lit(r"\E(?![\p{L}\p{Nd}])"))
        return F.regexp_replace(F.regexp_replace(acc, quoted, w["correct"]), high, titled)

    fixed = F.aggregate("wrong", F.col("flat"), put_right)
    return text.select(*key, F.coalesce(F.when(F.col("wrong").isNull(), F.col("flat")).otherwise(fixed), F.lit("")).alias("clean_text"))


QUERIES = {"p6_found": p6_found, "p6_text": p6_text}
ORACLE: dict[str, str] = {}
