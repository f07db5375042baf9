"""Who may find what: the documents that each question of a block may see, as bits, for every arm's own scan.

A question (question_id, owner_id, requested) may see what is public and its owner's own; ``requested`` narrows that and never widens it.
Null or no ``requested`` is all that the owner may see; documents of others that are asked for are left out, and a question of
nothing but such sees nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of questions that make a search scoped, and of passages that it then needs.
ASKED, HELD = ("owner_id", "requested"), ("document_id", "holder")


def is_scoped(questions: DataFrame) -> bool:
    """Questions with an owner are scoped, whatever else calls the arms."""
    return "owner_id" in questions.columns


def asked_columns(questions: DataFrame) -> list[str | Column]:
    """What an arm has to carry of scoped questions."""
    if not is_scoped(questions):
        return []
    return ["owner_id", "requested" if "requested" in questions.columns else F.lit(None).cast("array<string>").alias("requested")]


def searchable(passages: DataFrame, documents: DataFrame) -> DataFrame:
    """The passages of ready documents that nothing supersedes, each with its ``holder`` (null: public)."""
    held = documents.where("superseded_by is null and status = 'ready'").select("document_id", F.col("owner_id").alias("holder"))
    return passages.join(held, "document_id")


class Scope:
    """The scopes of a block of questions: one bit for each question, by holder and by requested document."""

    def __init__(self, asked: Sequence) -> None:
        self.n = len(asked)
        owners: dict[str, list[int]] = defaultdict(list)
        self.requested: dict[object, list[int]] = defaultdict(list)
        listed = np.zeros(self.n, bool)
        for k, r in enumerate(asked):
            if r.owner_id is not None:
                owners[r.owner_id].append(k)
            for document in set(r.requested or ()) - {None}:
                self.requested[document].append(k)
            listed[k] = bool(r.requested)
        self.unlisted = np.packbits(~listed)
        self.owned = {owner: np.packbits(np.isin(np.arange(self.n), own)) for owner, own in owners.items()}

    def allowed(self, documents: pa.Array, holders: pa.Array) -> np.ndarray:
        """Rows by questions: whether the question may see the row."""
        codes = holders.dictionary_encode(null_encoding="encode")
        everyone, nobody = np.full(-(-self.n // 8), 255, np.uint8), np.zeros(-(-self.n // 8), np.uint8)
        masks = np.stack([everyone if h is None else self.owned.get(h, nobody) for h in codes.dictionary.to_pylist()] or [nobody])
        visible = masks[codes.indices.to_numpy()]
        bits = visible & self.unlisted
        if self.requested:
            keys = list(self.requested)
            found = pc.index_in(documents, value_set=pa.array(keys, documents.type))
            for row in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)):
                one = np.zeros(self.n, bool)
                one[self.requested[keys[found[row].as_py()]]] = True
                bits[row] |= visible[row] & np.packbits(one)
        return np.unpackbits(bits, axis=1, count=self.n).astype(bool)


def may_see(holder: str = "holder", document: str = "document_id", owner: str = "owner_id", requested: str = "requested") -> Column:
    """The same rule as a condition on a row that has both a question's and a passage's columns."""
    own = F.col(holder).isNull() | F.coalesce(F.col(holder) == F.col(owner), F.lit(False))
    narrowed = F.coalesce(F.size(requested), F.lit(0)) > 0
    return own & (~narrowed | F.coalesce(F.array_contains(requested, F.col(document)), F.lit(False)))


def permissions(documents: DataFrame, asked: list) -> DataFrame:
    """(question_id, document_id) for each of ``documents`` (document_id, holder) that a question of the block may see."""
    sent = documents.sparkSession.sparkContext.broadcast((np.array([r.question_id for r in asked], np.int64), Scope(asked)))
    kind = documents.schema["document_id"].dataType.simpleString()

    def see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, scope = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                rows, questions = np.nonzero(scope.allowed(part.column("document_id"), part.column("holder")))
                yield pa.RecordBatch.from_arrays([pa.array(names[questions]), part.column("document_id").take(pa.array(rows))], ["question_id", "document_id"])

    return documents.select("document_id", "holder").mapInArrow(see, f"question_id long, document_id {kind}")
