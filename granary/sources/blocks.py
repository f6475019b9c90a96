"""One large CSV file read by many tasks, line breaks inside quotes included.

Spark's text reader deals a file out in blocks of whole lines. A line's parity of quotes says whether it opens or closes a quoted stretch, so a block has
a parity too, and the parities of the blocks before say whether a block begins inside quotes: one row for each block. With that, each task
puts its lines together to records; what hangs over a block's edge is a fragment, and fragments are put together by block.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.plans.table_plan import PlanError
from granary.sources.delimited import HEADER_LIMIT, detect_delimiter, records, table_cells

#: Bytes of lines that are left out as blank rows.
BLANKS = b" \r\t,;\xef\xbb\xbf"
_PIECES = "block long, line long, kind string, text binary"


def block_states(lines: DataFrame) -> DataFrame:
    """block, quoted (whether it begins inside quotes), utf8 (whether its lines are that): a row for each block."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    per = lines.groupBy("block").agg((F.sum(quotes) % 2).alias("odd"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # of one row for each block
    return per.select("block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("quoted"), "utf8")


def _pieces(batches):
    """Records, and the fragments at blocks' edges: `tail` ends a record of an earlier block, `head` begins one that goes on, `middle` is a
    block inside one."""
    block, line, held, first, inside, opened = None, 0, [], 0, False, False

    def closed():
        """What a block leaves open."""
        if held:
            yield block, first, "middle" if opened else "head", b"\n".join(held)

    for batch in batches:
        out = []
        odd = [n % 2 for n in pc.count_substring(batch.column(2), b'"').to_pylist()]
        for at, quoted, toggles, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), odd, batch.column(2).to_pylist(), strict=True):
            if at != block:
                out += closed()
                block, line, held, inside, opened = at, 0, [], quoted, quoted
            if not held:
                first = line
            held.append(text)
            inside ^= bool(toggles)
            if not inside:
                out.append((block, first, "tail" if opened else "record", b"\n".join(held)))
                held, opened = [], False
            line += 1
        yield _batch(out)
    yield _batch(list(closed()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["block", "line", "kind", "text"])


def _stitched(pieces: DataFrame) -> DataFrame:
    """Fragments as records under the place of their head. A record over several blocks is told by the number of heads up to a fragment."""
    edge = pieces.where("kind <> 'record'")
    order = Window.orderBy("block", "line")  # of at most two rows for each block, without their texts
    numbered = edge.select("block", "line", "kind").withColumn("record", F.sum((F.col("kind") == "head").cast("int")).over(order))
    part = F.struct("block", "line", "text")
    whole = edge.join(numbered.select("block", "line", "record"), ["block", "line"]).groupBy("record").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.bool_or(F.col("kind") == "head").alias("begun"), F.bool_or(F.col("kind") == "tail").alias("ended"))
    text = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["text"], lambda s, x: F.concat(s, F.lit(b"\n"), x["text"]))
    checked = F.when(F.col("begun") & F.col("ended"), text).otherwise(F.raise_error(F.lit("a quote that isn't closed")).cast("binary"))
    return whole.select(F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["line"].alias("line"), F.lit("record").alias("kind"), checked.alias("text"))


def read_csv_blocks(spark: SparkSession, path: str, fallback: str = "gb18030") -> DataFrame:
    """One file as a table of text columns with _row, which grows from row to row. The header decides the delimiter; quotes are as strict as in
    records(), blank rows are left out, short rows padded, and too long ones an error. A file that isn't UTF-8 throughout is read in the
    fallback's charset. Lines end in a line feed, with or without a carriage return. An empty file is an error."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_block_start").alias("block"), "value")
    states = block_states(lines)
    top = [bytes(r["v"]) for r in lines.where("block = 0").select(F.col("value").cast("binary").alias("v")).limit(1000).collect()]
    utf8 = states.agg(F.bool_and("utf8")).first()[0]
    charset = "utf-8" if utf8 is not False else fallback
    blank = next((k for k, line in enumerate(top) if line.strip(BLANKS)), len(top))  # lines before the header
    head = b"\n".join(top[blank:])[:HEADER_LIMIT].decode(charset, "ignore").removeprefix("\ufeff")
    delimiter = detect_delimiter(head)
    columns, _ = table_cells(records(_first_record(head), delimiter)[:1])

    dealt = lines.join(F.broadcast(states.select("block", "quoted")), "block")  # a row for each block; the join keeps lines in place
    pieces = dealt.select("block", "quoted", F.col("value").cast("binary").alias("value")).mapInArrow(_pieces, _PIECES)
    whole = pieces.where("kind = 'record'").unionByName(_stitched(pieces))
    width = len(columns)

    def cells(batches):
        for batch in batches:
            rows, places = [], []
            for block, line, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                said = text.decode(charset).removeprefix("\ufeff").removesuffix("\r")
                row = records(said, delimiter)[0] if said.strip("\r\n") else []
                if not any(c.strip() for c in row):
                    continue
                if any(c.strip() for c in row[width:]):
                    raise PlanError(f"a row has more cells than the header, in the block at {block}")
                rows.append((row + [""] * width)[:width])
                places.append((block << 23) + line)  # a block has fewer lines than bytes
            made = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.string())] * width
            yield pa.RecordBatch.from_arrays([*made, pa.array(places, pa.int64())], names=[*names, "_row"])

    names = [f"c{i}" for i in range(width)]
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField("_row", T.LongType())])
    table = whole.select("block", "line", "text").mapInArrow(cells, schema)
    return table.where(F.col("_row") > blank).toDF(*columns, "_row")  # the header is the record of block 0 at that line


def _first_record(text: str) -> str:
    quoted = False
    for at, c in enumerate(text):
        quoted ^= c == '"'
        if c in "\r\n" and not quoted:
            return text[:at]
    return text
