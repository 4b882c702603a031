"""Settings of an ingestion or a question, with their defaults."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    docs_source: tuple[str, ...] = ()
    file_types: tuple[str, ...] = (".pdf", ".docx", ".txt", ".md", ".xlsx", ".xlsm", ".xls", ".csv", ".doc", ".rtf")
    lock_file_patterns: tuple[str, ...] = ("~$*", ".~lock.*")
    signature_prefix_chars: int = 300
    batch_size: int = 100
    track_moves: bool = True
    track_deletions: bool = True
    max_retries: int = 3
    chunk_size: int = 1200
    chunk_overlap: int = 200
    min_chunk_chars: int = 200
    spreadsheet_max_rows: int = 5000
    embedding_model: str = "hashing-64"
    embedding_batch_size: int = 32
    ocr_min_chars_per_page: int = 50
    blank_page_chars: int = 10
    ocr_backend: str = "none"
    ocr_dpi: int = 300
    ocr_languages: str = "eng+kan"
    ocr_escalate_below_chars: int = 200
    ocr_max_pages_per_file: int = 500
    ocr_api_url: str = ""
    ocr_api_model: str = ""
    ocr_api_price: float = 0.0001
    top_k: int = 6
    min_score: float = 0.0
    max_context_chars: int = 6000
    pool_factor: int = 4
    pool_cap: int = 100
    rrf_k: int = 60
    other: dict = field(default_factory=dict)

    @classmethod
    def of(cls, values: dict) -> Settings:
        """Known keys become fields (lists become tuples); the rest stays in ``other``."""
        names = {f.name for f in dataclasses.fields(cls)}
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in names and v is not None}
        return cls(**known, other={k: v for k, v in values.items() if k not in names})


def load(path: str | Path) -> Settings:
    """A JSON file, or YAML where a YAML library is installed. A missing file is an error."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        import yaml

        return Settings.of(yaml.safe_load(text) or {})
    return Settings.of(json.loads(text))
