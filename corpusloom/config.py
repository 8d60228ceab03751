"""Settings and their defaults, as plain keyword values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results depend on them.
MAX_CHUNK_BYTES = 48_000  # longest chunk text, in UTF-8 bytes
LARGE_IMPL_LINES = 100  # an impl block spanning more lines is split
ITEM_NAME_CHARS = 60  # longest name taken from an item's first line
BYTES_PER_TOKEN = 4  # divisor of the token estimate
EMBED_BATCH_SIZE = 128  # texts per model call
DIMENSIONS = 1024  # embedding length
TOP_K = 10  # hits per query

# Size bounds of what may be sent to every executor (ours).
BROADCAST_BYTES = 64 << 20  # query or centroid matrix held by each Python worker
CELL_BYTES = 32 << 20  # one side of one scoring cell, or one block of queries, beyond that bound
INDEX_BLOCK_BYTES = 128 << 20  # index vectors that a task holds while all blocks of queries pass


@dataclass(frozen=True)
class SourceRoot:
    """A directory to index, with globs tested on the path below it."""

    path: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    """Everything one run needs; every field has a usable default."""

    roots: tuple[SourceRoot, ...] = field(default_factory=tuple)
    model: str = "hashing"
    dimensions: int = DIMENSIONS
    embed_batch_size: int = EMBED_BATCH_SIZE
    k: int = TOP_K
    max_chunk_bytes: int | None = MAX_CHUNK_BYTES  # None: no text is cut
    oversize: str = "truncate"  # or "split": longer chunks come in pieces and nothing is lost
