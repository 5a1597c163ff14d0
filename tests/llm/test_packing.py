import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")
ENCODER = P.Encoder(PATH)
APART = Tokenizer.from_file(PATH)  # not the object under test


def plain_ids(text):
    return np.array(APART.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


@given(st.lists(st.text(alphabet="aZé .,\n\t'st!?…½ |<>", max_size=40), max_size=5))
@settings(max_examples=200, deadline=None)
def test_encoder_equals_the_tokenizer(texts):
    assert ENCODER(texts) == [plain_ids(t) for t in texts]


def test_added_tokens_keep_their_ids():
    for text in ("x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c\n<|endoftext|> ", "no <|endoftext |> here"):
        assert ENCODER([text, "plain words"]) == [plain_ids(text), plain_ids("plain words")]
    assert 50256 in APART.encode("x <|endoftext|> y", add_special_tokens=False).ids


@given(st.lists(st.integers(0, 300), min_size=16, max_size=16))
@settings(max_examples=50, deadline=None)
def test_plan_uses_up_the_histogram(counts):
    histogram = np.array([0, *counts])
    used = np.zeros(17, dtype=int)
    for classes, use in P.plan(histogram):
        assert sum(classes) <= 16 and use > 0
        for a in classes:
            used[a] += use
    assert (used == histogram).all()


def check_whole(docs, rows, window=P.SEQUENCE):
    want = sorted((r.doc_id or -1, plain_ids(r.text) + b"\0\0\0\0") for r in docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert 0 < r.length <= window
    for spans in by.values():
        at = 0
        for low, size in sorted(spans):
            assert low == at
            at += size
        assert at <= window
    left = [(r.doc_id or -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows]
    for i, ids in want:
        for low in range(0, len(ids) // 4, window):
            part = ids[4 * low:4 * (low + window)]
            left.remove((i, low, len(part) // 4, zlib.crc32(part), len(ids) // 4))
    assert not left
    return sum(r.length for r in rows) / (len(by) * window)


def test_odd_rows(odd, none):
    check_whole(odd, P.pack(odd, PATH).collect())
    assert P.pack(none, PATH).count() == 0


def test_little_padding(docs_of):
    rng = np.random.default_rng(1)
    docs = docs_of([(i, " ".join(["word"] * int(rng.integers(1, 700)))) for i in range(600)])
    assert check_whole(docs, P.pack(docs, PATH).collect()) > 0.985


def test_a_word_is_looked_at_once(monkeypatch):
    """Odd white space is sought in new words, not in every text again."""
    import public_tokenizers

    from llm import packing

    met, odd = [], packing.odd
    monkeypatch.setattr(packing, "odd", lambda word: met.append(word) or odd(word))
    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a b c", "a b", "x\ta b", " a", "a\n", "a  b", "a\n\nb", "\n", " ", "b\u2003a", "a\nb c", "a<|endoftext|>b c", ""]
    assert encode(texts) == encode._encode(texts)
    met.clear()
    assert encode(["a b c b c"] * 50) == encode._encode(["a b c b c"] * 50)
    assert set(met) <= {"a"}  # a first word has no blank before it and is not kept


def test_a_known_word_is_looked_up_once_a_block():
    """However often a block repeats a word; the ids stay the tokenizer's."""
    class Counted(dict):
        asked = 0

        def _count(name):
            def ask(self, *key):
                self.asked += 1
                return getattr(dict, name)(self, *key)
            return ask

        get, __getitem__, __contains__ = map(_count, ("get", "__getitem__", "__contains__"))

    encode, texts = P.Encoder(PATH), ["x one, two three one", "y two one three, two", None, ""] * 50
    first = encode(texts)
    encode.known = Counted(encode.known)
    assert encode(texts) == first == [plain_ids(t) for t in texts]
    assert encode.known.asked <= 8


def test_a_worker_that_turns_to_another_pass_holds_no_encoder(spark, docs_of):
    """Workers outlive the pass, and the ids of a million words are as large as all that another pass needs."""
    P.pieces(docs_of([(i, f"some words {i}") for i in range(64)]).repartition(8), PATH).count()

    def run(batches):
        import gc

        import pyarrow as pa

        from llm import words

        for batch in words.blocks(batches):
            held = sum(type(o).__module__ == "llm.packing" and type(o).__name__ == "Encoder" for o in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([held])], names=["held"])

    other = docs_of([(i, "x") for i in range(64)]).repartition(8).select("text").mapInArrow(run, "held long")
    assert sum(r.held for r in other.collect()) == 0


def test_the_encoder_starts_no_threads():
    """A task has a core; threads of the tokenizer hold memory of their own in every worker."""
    code = (f"import os; from llm import packing as P; e = P.Encoder({PATH!r}); count = lambda: len(os.listdir('/proc/self/task')); n = count(); "
            "e._encode([f'some words {i}' for i in range(999)]); print(count() - n)")
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(P.__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root, env=env, capture_output=True, text=True, check=True).stdout.split() == ["0"]
