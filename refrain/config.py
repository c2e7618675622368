"""Settings of a text-reuse run."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class ReuseConfig:
    """All settings; the names follow the command line, defaults included.

    ``compat`` keeps two published behaviours: a source whose first match lies in the first n characters of a
    target may be lost (``seed_start=True`` starts it at once), and a first anchor at target offset 0 is left out.
    """

    id: str = "id"
    text: str = "text"
    locs: str = "locs"
    pages: str = "pages"
    min_df: int = 2
    max_df: int = 100
    min_match: int = 5
    n: int = 25
    floating_ngrams: bool = False
    complete_lines: bool = False
    gap: int = 600
    max_offset: int = 20
    beam: int = 20
    pcopy: float = 0.8
    min_align: int = 50
    src_overlap: float = 0.9
    dst_overlap: float = 0.5
    fields: tuple[str, ...] = ()
    filterpairs: str = "uid < uid2"
    all_pairs: bool = False
    pairwise: bool = False
    docwise: bool = False
    linewise: bool = False
    refpref: bool = False
    to_index: bool = False
    to_pairs: bool = False
    to_extents: bool = False
    link_model: str | None = None
    link_features: str | None = None
    log_level: str = "WARN"
    shards: int = 1
    input_format: str = "json"
    output_format: str = "json"
    seed_start: bool = False
    hash_features: bool = True

    def __post_init__(self) -> None:
        if self.n < 1 or self.shards < 1 or self.min_match < 1:
            raise ValueError("n, shards and min_match must be positive")
        if not 0 < self.pcopy < 1:
            raise ValueError("pcopy must lie between 0 and 1")
        if self.min_df > self.max_df:
            raise ValueError("min_df must not exceed max_df")

    @property
    def pad(self) -> int:
        return int((self.n - 1) / 2)

    def fingerprint(self, *stage_fields: str) -> str:
        """A hash of the settings that a stage depends on (all of them, if none is named)."""
        keep = set(stage_fields) or {f.name for f in fields(self)}
        return hashlib.sha256(json.dumps({k: v for k, v in asdict(self).items() if k in keep}, sort_keys=True).encode()).hexdigest()[:16]
