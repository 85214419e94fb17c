"""Main text of web pages: blocks labelled by a recurrent network that reads the whole page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, FloatType, LongType, StringType, StructField, StructType

from plumbline.llm.blocks import blocks_of
from plumbline.llm.labeller import Reader, labelled, trained
from plumbline.llm.rows import with_computed

BLOCKS = ArrayType(StructType([StructField("text", StringType()), StructField("path", StringType()), StructField("score", FloatType()), StructField("main", BooleanType())]))


def main_text(pages: DataFrame, model: dict | None = None, *, html_col: str = "html", keep: list[str] | None = None, blocks: bool = True) -> DataFrame:
    """Columns `keep` of `pages` (None: all) plus text, n_chars (code points) and, if asked for, blocks.

    text: the blocks labelled as main text in page order, joined by line ends; an empty string if there are none. A
    null or empty page and one without text have no blocks. Pages are labelled each by itself; repeated rows have
    equal results; no rows give no rows. Columns of `pages` named like an output column are replaced.
    """
    made = [StructField("text", StringType()), StructField("n_chars", LongType())] + [StructField("blocks", BLOCKS)] * blocks
    shared = pages.sparkSession.sparkContext.broadcast(trained() if model is None else model)

    def start():
        labeller, reader = shared.value, Reader()

        def compute(raw: list[bytes]) -> dict[str, object]:
            read = [blocks_of(p.decode("utf-8", "replace")) for p in raw]
            score = labelled(labeller, reader, read)
            texts, shown, at = [], [], 0
            for page in read:
                own = score[at : at + len(page)]
                at += len(page)
                texts.append("\n".join(b.text for b, s in zip(page, own) if s > 0))
                if blocks:
                    shown.append([{"text": b.text, "path": " > ".join(b.path), "score": float(s), "main": bool(s > 0)} for b, s in zip(page, own)])
            out: dict[str, object] = {"text": texts, "n_chars": [len(t) for t in texts]}
            return out | ({"blocks": shown} if blocks else {})

        return compute

    return with_computed(pages, html_col, StructType(made), start, keep)


def op1(pages: DataFrame) -> DataFrame:
    """Contract columns of the extraction query."""
    return main_text(pages.select("page_id", "url", "html"), keep=["page_id", "url"], blocks=False)
