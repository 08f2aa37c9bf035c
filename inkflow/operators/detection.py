"""Structure detection by chunks: a port answers in JSON for one chunk; what fails is one paragraph, and nothing else."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkflow.functions import text as T

#: Fixed value: the characters of a chunk.
CHUNK_CHARS = 3500
#: Chunks whose responses a task holds at once.
SLICE = 200
RESPONSE = "blocks array<struct<type: string, level: int, text: string, style: string, metadata: struct<attribution: string, caption: string, number: string>>>"
ANSWER = "doc_id long, chunk_no int, chunk string, response string, error string"
#: (chunk, number from 1, number of chunks) to JSON; it may raise or answer anything.
Port = Callable[[str, int, int], str]


def chunks(docs: DataFrame, text: Column, most: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, chunk_no from 1, n_chunks, chunk: whole lines packed up to most characters, longer ones whole; documents
    without a filled line have none."""
    parts = F.filter(F.split(text, "\n", -1), lambda x: T.strip(x) != "")
    packed = docs.select("doc_id", T.chunk_by(parts, most, "\n\n", 2, True).alias("cs")).where("size(cs) > 0")
    rows = packed.select("doc_id", F.size("cs").alias("n_chunks"), F.posexplode("cs").alias("p", "chunk"))
    return rows.select("doc_id", (F.col("p") + 1).alias("chunk_no"), "n_chunks", "chunk")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SLICE):
        yield batch.slice(at, SLICE)


def answers(rows: DataFrame, port: Port) -> DataFrame:
    """ANSWER: the port's response to each chunk, or the error that it raised.  A task holds one batch as Arrow has it, and of
    SLICE rows the chunks and responses as Python has them; a chunk that fails leaves the others alone; a task that is run again
    asks again."""

    def ask(chunk: str, no: int, n: int) -> tuple[str | None, str | None]:
        try:
            return port(chunk, no, n), None
        except Exception as e:  # whatever a port raises is the chunk's failure
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                got = [ask(*r) for r in zip(*(b.column(c).to_pylist() for c in ("chunk", "chunk_no", "n_chunks")), strict=True)]
                columns = [b.column("doc_id").cast(pa.int64()), b.column("chunk_no"), b.column("chunk"), pa.array([r for r, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "chunk_no", "chunk", "response", "error"])

    return rows.select("doc_id", "chunk_no", "n_chunks", "chunk").mapInArrow(run, ANSWER)


def blocks(answered: DataFrame) -> DataFrame:
    """doc, ord, chunk_no, failed and the fields of a block, the chunks' blocks in the order of chunks.  A chunk has failed if its
    port raised or its answer is no JSON object; then it is one paragraph block.  An object without blocks gives none."""
    parsed = F.from_json("response", RESPONSE)
    failed = F.coalesce(F.get_json_object("response", "$").isNull() | ~F.ltrim("response").startswith("{"), F.lit(True))
    alone = F.from_json(F.lit('{"blocks": [{"type": "paragraph", "style": "normal"}]}'), RESPONSE)["blocks"]
    whole = F.transform(alone, lambda b: b.withField("text", F.col("chunk")))
    flagged = answered.withColumn("failed", failed)
    rows = flagged.select("doc_id", "chunk_no", "failed", F.posexplode(F.when(F.col("failed"), whole).otherwise(parsed["blocks"])).alias("pos", "b"))
    order = Window.partitionBy("doc_id").orderBy("chunk_no", "pos")
    kind = F.coalesce("b.type", F.lit("paragraph"))
    return rows.select(
        F.col("doc_id").alias("doc"), F.row_number().over(order).alias("ord"), "chunk_no", "failed", kind.alias("type"), "b.level", "b.text", "b.style", "b.metadata.attribution", "b.metadata.caption", "b.metadata.number"
    )


def detected(docs: DataFrame, port: Port, normalised: bool = True) -> DataFrame:
    """blocks() of documents (doc_id, text); texts of printed pages are taken as they are, others are normalised first.  Null and
    blank texts have no blocks; repeated doc_ids are one document, whose chunks of one number follow in no order."""
    text = F.coalesce("text", F.lit(""))
    return blocks(answers(chunks(docs, T.normalize_pdf(text) if normalised else text), port))
