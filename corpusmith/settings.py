"""Options with their default values; plain arguments, not a table."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The defaults users of the library and of the web form rely on.
CHUNK_SIZE = 2048
CHUNK_OVERLAP = 256
WEB_CHUNK_SIZE = 1024
WEB_CHUNK_OVERLAP = 128
TOP_K = 5
MAX_TOKENS = 4096
VECTOR_DIM = 384
BATCH_SIZE = 8
BUNDLE_FOLDER = "concated"

# Texts shown to users.
SYSTEM_PROMPT = (
    "You are an expert code analysis assistant. "
    "Analyze code thoroughly and provide detailed, accurate explanations."
)
NO_INDEX_MESSAGE = "⚠️ Please select and process a code directory first"
NO_DIRECTORY_MESSAGE = "❌ Directory does not exist"
NO_DOCUMENTS_MESSAGE = "❌ No documents found in directory"
SUCCESS_PREFIX = "✅ Successfully processed "
SUCCESS_SUFFIX = " files"
ERROR_PREFIX = "❌ Error: "
SOURCES_HEADER = "\n\n📚 Source Files:"
UNKNOWN_PATH = "Unknown"
DEFAULT_MIME = "application/octet-stream"


@dataclass(frozen=True)
class Settings:
    """Options of one index: how texts are cut, embedded and searched."""

    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    top_k: int = TOP_K
    max_tokens: int = MAX_TOKENS
    dim: int = VECTOR_DIM
    recursive: bool = True

    def __post_init__(self):
        check_chunking(self.chunk_size, self.chunk_overlap)

    def web(self) -> "Settings":
        """The smaller chunks and the top-level scan of the web form."""
        return replace(
            self,
            chunk_size=WEB_CHUNK_SIZE,
            chunk_overlap=WEB_CHUNK_OVERLAP,
            recursive=False,
        )


def check_chunking(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError(f"chunk size must be positive, not {size}")
    if overlap < 0 or overlap >= size:
        raise ValueError(f"overlap must lie in [0, {size}), not {overlap}")
