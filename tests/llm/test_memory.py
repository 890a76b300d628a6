"""What a task holds at once."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from waymark.llm import exact_dedup, near_dedup, packing, quality
from waymark.llm.queries import tokenizer_path


def test_quality_judges_few_bytes_at_once(monkeypatch):
    sizes, rules = [], quality.rules
    monkeypatch.setattr(quality, "rules", lambda texts, ratio: sizes.append(sum(map(len, texts.to_pylist()))) or rules(texts, ratio))
    batch = pa.RecordBatch.from_pydict({"text": ["one two three " * 70_000] * 7})
    (whole,) = {tuple(x.column("n_words").to_pylist()) for x in quality._scored(None, [], "text")(iter([batch.slice(0, 1)]))}
    sizes.clear()
    found = [n for x in quality._scored(None, [], "text")(iter([batch])) for n in x.column("n_words").to_pylist()]
    assert found == [*whole] * 7 and max(sizes) <= 2 << 20


def test_packing_encodes_few_bytes_at_once(monkeypatch):
    sizes, encode = [], packing.WordIds.__call__
    monkeypatch.setattr(packing.WordIds, "__call__", lambda self, texts: sizes.append(sum(map(len, texts.to_pylist()))) or encode(self, texts))
    text = "one two three " * 50_000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": [text] * 5})
    want = len(Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids) + 1
    for run in (packing._measured, packing._tails):
        assert [n for x in run(tokenizer_path())(iter([batch])) for n in x.column("total").to_pylist()] == [want] * 5
    assert max(sizes) <= 1 << 20


def test_packing_remembers_pieces_in_little_memory(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBER", 3000)
    found, plain = packing.WordIds(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for k in (0, 1, 0, 2, 3):  # words met again, words that are new, and more than are remembered
        texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 + k)}" for i in range(n)) for n in (1200, 3, 0)] + ["it's \u00e9t\u00e9 <|endoftext|> \x00", None]
        assert [x.tolist() for x in found(pa.array(texts))] == [[*plain.encode(t or "", add_special_tokens=False).ids, packing.END] for t in texts]
    held = sum(x.nbytes for x in vars(found).values() if isinstance(x, np.ndarray))
    assert 1200 <= len(found.hashes) <= 3000 and held <= 40 * len(found.hashes)


def test_dedups_take_few_bytes_at_once(monkeypatch):
    sizes, given, sets = [], [], near_dedup.shingle_sets
    monkeypatch.setattr(near_dedup, "shingle_sets", lambda texts, n: sizes.append(sum(map(len, texts.to_pylist()))) or sets(texts, n))
    by_bytes = exact_dedup.by_bytes
    monkeypatch.setattr(exact_dedup, "by_bytes", lambda *a, **k: (sizes.append(x.column("text").nbytes) or x for x in by_bytes(*a, **k)))
    for module in (near_dedup, exact_dedup, packing, quality):
        monkeypatch.setattr(module, "give_back", lambda: given.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": [f"{i} " + "one two three " * 30_000 for i in range(7)]})
    every, alone = np.full(1 << 10, 255, np.uint8), [sets(batch.column("text").slice(i, 1), 5)[0] for i in range(7)]
    assert [r for x in near_dedup._signed(5, ["doc_id"])(iter([batch])) for r in x.column("set_id").to_pylist()] == [near_dedup.digest(x) for x in alone]
    assert sum(x.num_rows for x in near_dedup._sets(5, every)(iter([batch]))) == 7
    assert len({r for x in exact_dedup._narrow(["doc_id"])(iter([batch])) for r in x.column("sha").to_pylist()}) == 7
    assert len({r for x in exact_dedup._chunked(every)(iter([batch])) for r in x.column("doc_id").to_pylist()}) == 7
    assert max(sizes) <= (1 << 20) + 64 and len(given) == 4  # each task gives back what it no longer uses
