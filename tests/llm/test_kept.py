"""Tables that an operator keeps in its workers go before a task of another operator starts."""

import numpy as np
import pyarrow as pa

from tidewheel.llm import _text, bpe, suffix_dedup


def test_other_tasks_drop_the_codec(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("".join(f"{__import__('base64').b64encode(bytes([k])).decode()} {k}\n" for k in range(256)))
    kept = bpe.codec(str(path), r"\S+|\s+")
    assert list(_text.released(lambda batches: batches, "bpe")(iter([pa.record_batch({"a": [1]})])))
    assert bpe.codec(str(path), r"\S+|\s+") is kept
    assert list(_text.released(lambda batches: batches)(iter([pa.record_batch({"a": [1]})])))
    assert bpe.codec.cache_info().currsize == 0


def test_windows_are_hashed_half_a_megabyte_at_once(monkeypatch):
    """Every slice of a task is within the bound, whatever the batch holds."""
    seen = []
    real = suffix_dedup.minimizers
    monkeypatch.setattr(suffix_dedup, "minimizers", lambda buf, *a: seen.append(len(buf)) or real(buf, *a))
    texts = pa.record_batch({"id": np.arange(40), "text": ["abc def " * 5000] * 40, "keys": pa.array([[]] * 40, pa.list_(pa.int64()))})

    class Plan:
        def mapInArrow(self, run, schema):
            list(run(iter([texts])))

    suffix_dedup.segments(Plan(), 50, 20, 4, np.zeros(0, np.uint64))
    assert sum(seen) == 40 * 40_000 and max(seen) <= 1 << 19
