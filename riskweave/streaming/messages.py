"""Messages of a stream admitted once each, across micro-batches and restarts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from riskweave.operators.delivery import SeenLedger


def admit_stream(
    messages: DataFrame,
    ledger: SeenLedger,
    id_col: str,
    order: Callable[[], Sequence[Column]],
    payload: Sequence[str],
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = False,
) -> StreamingQuery:
    """Starts a query that hands ``write`` the admitted messages of each micro-batch, with the batch's number.

    The state is the ledger, exact for any age of repeat, in place of a
    watermarked state that forgets. A micro-batch that is run again after a
    fault carries the number of the last commit and gets the same answer, so
    ``write`` sees the same rows; it should overwrite by batch number. ``once``
    takes what is there and ends.
    """

    def run(batch: DataFrame, number: int) -> None:
        got = ledger.admit(batch, id_col, order(), payload, token=str(number))
        write(got.where("admitted").select(F.col("id").alias(id_col), *payload), number)

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
