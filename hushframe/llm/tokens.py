"""Token ids of texts by a given tokenizer file, in blocks that can be read again without the texts."""

from __future__ import annotations

import os
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import slices, written

BLOCK_IDS = 1 << 18
BLOCKS = "part long, block long, at long, doc_ids array<long>, queues array<string>, sizes array<long>, ids binary"


#: A word of letters whose small forms and compositions are plain, with the punctuation behind it.
PLAIN = "^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[.,;:!?]*)$"
#: Distinct parts that a worker keeps the ids of.
KEPT_PARTS = 1_000_000


def chunk_encoder(spec: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Ids of all texts of a column, one after another, and their number per text.

    The tokenizer drops white space and never joins what it parts, so the distinct runs of other characters are
    encoded once, and of plain words the letters and the punctuation apart, as the tokenizer parts them too.
    The strings of added tokens in a text are those tokens, as the library reads them.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    known: dict[str, bytes] = {}

    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    ends[[i for w, i in tokenizer.get_vocab().items() if suffix and w.endswith(suffix)]] = True

    def learn(parts: list[str]) -> None:
        for part, e in zip(parts, tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            known[part] = array("I", e.ids).tobytes()

    def learn_words(words: list[str]) -> None:
        """Words of letters: many in one text cost less, and each ends at an id with the end-of-word suffix."""
        lines = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
        ids = [array("I", e.ids) for e in tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in ids)])
        cuts = np.flatnonzero(ends[flat]) + 1
        if len(cuts) != len(words):
            return learn(words)
        data = flat.astype(np.uint32).tobytes()
        for word, first, last in zip(words, [0, *cuts[:-1].tolist()], cuts.tolist()):
            known[word] = data[4 * first : 4 * last]

    def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(known) > KEPT_PARTS:  # the memory of a worker stays bounded
            known.clear()
        texts = pc.fill_null(column, "").cast(pa.large_string())
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary
        found = pc.extract_regex(chunks, PLAIN)
        plain = found.is_valid()
        # each run is a word of letters and its punctuation, or itself and nothing
        words = pc.if_else(plain, pc.utf8_lower(pc.struct_field(found, "word")), chunks).dictionary_encode()
        signs = pc.if_else(plain, pc.struct_field(found, "signs"), pa.scalar("", pa.large_string())).dictionary_encode()
        first, second = words.indices.to_numpy(), signs.indices.to_numpy()
        parts, behind = words.dictionary.to_pylist(), signs.dictionary.to_pylist()
        letters = np.zeros(len(parts), bool)
        letters[first[np.array(plain, bool)]] = True
        new = [i for i, x in enumerate(parts) if x not in known]
        learn_words([parts[i] for i in new if letters[i]])
        learn([parts[i] for i in new if not letters[i]] + [x for x in behind if x not in known])
        each = [known[x] for x in (*parts, *behind)]
        store = np.frombuffer(b"".join(each), np.uint32)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        both = np.stack([first, second + len(parts)], axis=1)[coded.indices.to_numpy()].reshape(-1)
        starts, lengths = (np.cumsum(size) - size)[both], size[both]
        total = np.cumsum(lengths)
        flat = store[np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)]
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], total])[2 * np.cumsum(counts)]
        return flat, np.diff(ends, prepend=0)

    return encode


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, pa.Array]]:
    """Ids, queues and texts of the rows, a bounded part at a time."""
    for batch in batches:
        first = 0
        for some in slices(batch.column(2)):
            ids, queues = (batch.column(c).slice(first, len(some)).to_pylist() for c in (0, 1))
            yield ids, queues, some
            first += len(some)


def with_end(flat: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The end id after each text's ids."""
    return np.insert(flat, np.cumsum(sizes), np.uint32(end)), sizes + 1


def packed(ids: np.ndarray) -> bytes:
    """Compressed ids, byte by byte of their places; two bytes each if they fit."""
    import zstandard

    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    planes = ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1)


def token_blocks(docs: DataFrame, doc_id: Column, queue: Column, text: Column, path: str, end: int, name: str) -> DataFrame:
    """Blocks of whole documents in the order of the rows, written to the shared folder.

    `at` counts the partition's ids before the block. A block has at least `BLOCK_IDS` ids or is the last of its partition; a longer document is a block by itself.
    """
    with open(path, encoding="utf-8") as file:
        # a worker keeps its copy of a broadcast, and with it the encoder and the words it knows, through its tasks
        spec = docs.sparkSession.sparkContext.broadcast((file.read(), {}))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, kept = spec.value
        if "encode" not in kept:
            kept["encode"] = chunk_encoder(text)
        encode, part = kept["encode"], TaskContext.get().partitionId()
        block, at, held = 0, 0, []

        def out() -> pa.RecordBatch:
            ids, queues, sizes, parts = (sum((h[k] for h in held), []) for k in range(4))
            row = [[part], [block], [at], [ids], [queues], [sizes], [packed(np.concatenate(parts))]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], [c.split()[0] for c in BLOCKS.split(", ")])

        count = 0
        for doc_ids, queues, some in parts_of(batches):
            flat, sizes = with_end(*encode(some), end)
            ends = np.cumsum(sizes)
            first = 0
            while first < len(sizes):
                before = ends[first] - sizes[first]
                last = min(len(sizes), int(np.searchsorted(ends, before + BLOCK_IDS - count)) + 1)
                held.append((doc_ids[first:last], queues[first:last], sizes[first:last].tolist(), [flat[before : ends[last - 1]]]))
                count += int(ends[last - 1] - before)
                if count >= BLOCK_IDS:
                    yield out()
                    block, at, count, held = block + 1, at + count, 0, []
                first = last
        if held:
            yield out()

    return written(docs.select(doc_id.cast("long"), queue.cast("string"), text).mapInArrow(made, BLOCKS), name)
