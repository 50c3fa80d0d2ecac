"""What a worker holds while it samples segmentations of texts whose words are nearly all new."""

import random
import tracemalloc

import pyarrow as pa

from textloom.llm import segmentation
from textloom.llm.queries import tokenizer


class Captured:
    """Stands for the documents; keeps the function that the tasks run."""

    def mapInArrow(self, function, schema):
        self.function = function
        return self


def test_blocks_are_small_and_results_do_not_depend_on_them(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "documents", lambda *_: Captured())
    monkeypatch.setattr(segmentation, "_loaded", {})
    run = lambda rows: list(segmentation.sample_segmentations(None, tokenizer(spark, "piece_bpe_32k.model")).function(iter([rows])))
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("aeinorst", k=rng.randint(4, 9))) for _ in range(300)) for _ in range(600)]
    rows = pa.record_batch([pa.array(range(600), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    made = sum(b.num_rows for b in run(rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 1200 and peak < 100e6, peak
    few = rows.slice(0, 90)
    whole = pa.Table.from_batches(run(few))
    monkeypatch.setattr(segmentation, "BLOCK_CHARS", 20_000)
    monkeypatch.setattr(segmentation, "KEPT_CHUNKS", 3_000)
    assert pa.Table.from_batches(run(few)).equals(whole) and all(whole["decoded"].to_pylist())
