"""The document model as nested JSON: a document per row, and books of any size as ordered pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkflow.functions import text as T

BLOCK = "struct<type: string, text: string, style: string, alignment: string, indent: double, spacing_before: double, spacing_after: double, footnote_refs: array<int>, is_quote: boolean, heading_level: int>"
PARAGRAPH = "struct<text: string, style: string, alignment: string, indent: double, spacing_before: double, spacing_after: double>"
METADATA = "struct<title: string, author: string, isbn: string, language: string, word_count: bigint, page_count_estimate: bigint, has_front_matter: boolean, has_back_matter: boolean, detected_by_ai: boolean, ai_cost: double>"
CHAPTER = f"struct<title: string, number: bigint, blocks: array<{BLOCK}>, footnotes: array<struct<number: int, text: string, reference_location: string>>, start_on_recto: boolean>"
#: The columns of a document's line of JSON.
SCHEMA = f"doc_id bigint, metadata {METADATA}, chapters array<{CHAPTER}>, front_matter array<{PARAGRAPH}>, back_matter array<{PARAGRAPH}>"


def _struct(kind: str, **fields) -> Column:
    return F.struct(*(v.alias(k) if isinstance(v, Column) else F.lit(v).alias(k) for k, v in fields.items())).cast(kind)


def metadata(words: Column, language: Column) -> Column:
    return _struct(METADATA, title="", author="", isbn="", language=F.coalesce(language, F.lit("en")), word_count=words, page_count_estimate=0, has_front_matter=False, has_back_matter=False, detected_by_ai=False, ai_cost=0.0)


def paragraph_block(text: Column) -> Column:
    return _struct(BLOCK, type="paragraph", text=text, style="normal", alignment="left", indent=0.0, spacing_before=0.0, spacing_after=0.0, footnote_refs=F.array(), is_quote=False, heading_level=F.lit(None))


def document_model(docs: DataFrame, paras: DataFrame) -> DataFrame:
    """The columns of SCHEMA from documents (doc_id, text, lang) and structure.paragraphs(..., main_content=True): paragraphs to
    chapters, chapters to a document, which is no larger than a few times the text it came from.  Paragraphs before the first
    title drop.  A document of null, empty or blank text has no chapters.  doc_id is the key; null ones form a document."""
    kept = paras.where("title is not null")
    chapters = kept.groupBy("doc_id", "section_no").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(F.struct("paragraph_no", "text"))).alias("ps"))
    chapter = F.struct("section_no", "title", F.transform("ps", lambda p: paragraph_block(p["text"])).alias("blocks"))
    books = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_no", chapter.alias("c")))).alias("cs"))
    number = lambda c, i: F.when(F.lower(c["c"]["title"]).startswith("chapter"), i + 1)
    built = F.transform("cs", lambda c, i: _struct(CHAPTER, title=c["c"]["title"], number=number(c, i), blocks=c["c"]["blocks"], footnotes=F.array(), start_on_recto=True))
    facts = docs.select("doc_id", F.coalesce(T.word_count(F.col("text")), F.lit(0)).alias("n"), "lang")
    joined = facts.join(books.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    none = F.array()
    return joined.select("doc_id", metadata(F.col("n"), F.col("lang")).alias("metadata"), F.coalesce(built, none.cast(f"array<{CHAPTER}>")).alias("chapters"), none.cast(f"array<{PARAGRAPH}>").alias("front_matter"), none.cast(f"array<{PARAGRAPH}>").alias("back_matter"))


def write_models(models: DataFrame, path: str) -> None:
    """A line of JSON a document, fields of null kept."""
    models.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def read_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)


def blocks_of(models: DataFrame) -> DataFrame:
    """doc_id, n_words of the document, chapter_no and block_no from 1, title, number, type, text."""
    chapters = models.select("doc_id", F.col("metadata.word_count").alias("n_words"), F.posexplode("chapters").alias("c", "chapter"))
    rows = chapters.select("doc_id", "n_words", (F.col("c") + 1).cast("long").alias("chapter_no"), F.col("chapter.title").alias("title"), F.col("chapter.number").alias("number"), F.posexplode("chapter.blocks").alias("b", "block"))
    return rows.select("doc_id", "n_words", "chapter_no", "title", "number", (F.col("b") + 1).cast("long").alias("block_no"), F.col("block.type").alias("type"), F.col("block.text").alias("text"))


def quoted(c: Column) -> Column:
    """A JSON string; non-ASCII characters stay."""
    inner = F.to_json(F.array(c))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def _lines(depth: int, *rows: str) -> str:
    return "\n".join(" " * (2 * depth) + r for r in rows)


#: The model's text around what varies, in two blanks a level.
HEAD = (
    _lines(0, "{", '  "metadata": {') + "\n" + _lines(2, '"title": "",', '"author": "",', '"isbn": "",', '"language": "en",', '"word_count": '),
    ",\n" + _lines(2, '"page_count_estimate": 0,', '"has_front_matter": false,', '"has_back_matter": false,', '"detected_by_ai": false,', '"ai_cost": 0.0') + "\n" + _lines(1, "},", '"chapters": ['),
)
OPEN = (_lines(2, "{", '  "title": '), ",\n" + _lines(3, '"number": '), ",\n" + _lines(3, '"blocks": [') + "\n")
BODY = (
    _lines(4, "{", '  "type": "paragraph",', '  "text": '),
    ",\n" + _lines(5, '"style": "normal",', '"alignment": "left",', '"indent": 0.0,', '"spacing_before": 0.0,', '"spacing_after": 0.0,', '"footnote_refs": [],', '"is_quote": false,', '"heading_level": null') + "\n" + _lines(4, "}"),
)
CLOSE = "\n" + _lines(3, "],", '"footnotes": [],', '"start_on_recto": true') + "\n" + _lines(2, "}")
TAIL = _lines(1, "],", '"front_matter": [],', '"back_matter": []') + "\n}"
ORDER = ["source", "part", "doc_id", "section_no", "block_no"]


def book_pieces(docs: DataFrame, paras: DataFrame) -> DataFrame:
    """ORDER and piece: a book a source, of the chapters of its documents (doc_id, source, text) in their order.  In ORDER, a
    line break between each two, the pieces of a source are its JSON.  A piece is one block with what opens or closes its
    chapter, so no row holds a chapter or a book; what opens a book (part 0) and closes it (part 2) are rows of their own.  Only
    sources with a chapter are books; null sources and null doc_ids drop, as they name none; doc_id is the key."""
    named = docs.where("source is not null and doc_id is not null")
    kept = paras.where("title is not null").join(named.select("doc_id", "source"), "doc_id")
    sized = kept.groupBy("doc_id", "source", "section_no").agg(F.max("paragraph_no").alias("last"))
    chapters = sized.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("section_no")))
    final = chapters.groupBy("source").agg(F.max(F.struct("doc_id", "section_no")).alias("f")).select("source", "f.*", F.lit(True).alias("ends"))
    words = named.groupBy("source").agg(F.sum(F.coalesce(T.word_count(F.col("text")), F.lit(0))).alias("n"))
    lit, c = F.lit, F.col

    rows = kept.join(chapters.drop("source"), ["doc_id", "section_no"]).join(final, ["source", "doc_id", "section_no"], "left")
    number = F.when(F.lower("title").startswith("chapter"), c("rank").cast("string")).otherwise("null")
    opened = F.concat(lit(OPEN[0]), quoted(c("title")), lit(OPEN[1]), number, lit(OPEN[2]))
    closed = F.concat(lit(CLOSE), F.when(c("ends"), "").otherwise(","))
    piece = F.concat(
        F.when(c("paragraph_no") == 1, opened).otherwise(""), lit(BODY[0]), quoted(c("text")), lit(BODY[1]), F.when(c("paragraph_no") == c("last"), closed).otherwise(",")
    )
    middle = rows.select("source", lit(1).alias("part"), "doc_id", "section_no", c("paragraph_no").alias("block_no"), piece.alias("piece"))

    nothing = [lit(0).cast("long").alias(k) for k in ORDER[2:]]
    books = final.select("source").join(words, "source")
    heads = books.select("source", lit(0).alias("part"), *nothing, F.concat(lit(HEAD[0]), c("n").cast("string"), lit(HEAD[1])).alias("piece"))
    tails = books.select("source", lit(2).alias("part"), *nothing, lit(TAIL).alias("piece"))
    return middle.unionByName(heads).unionByName(tails)


def write_books(pieces: DataFrame, path: str) -> None:
    """A folder of text files a source, which in the order of their names are its JSON; a hot source is split by ranges."""
    ordered = pieces.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    ordered.select("source", F.col("piece").alias("value")).write.mode("errorifexists").partitionBy("source").text(path)
