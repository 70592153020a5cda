"""Settings of a corpus and of retrieval. Nothing here belongs to one statute; an example is in the tests."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class CorpusConfig:
    """What the structure, chunk and annotation steps need to know about a corpus."""

    law_id: str = "LAW"
    law_title: str = ""
    issued_date: str = ""
    gazette_issue: str = ""
    long_article: int = 1500  # bodies of more characters are split
    max_title: int = 100
    per_document: bool = True  # each document is a law of its own; else all are one law, and the later article of a number counts

    @property
    def prefix(self) -> str:
        return self.law_id.lower()


@dataclass(frozen=True)
class Profile:
    primary_k: int
    definitions_per_article: int
    crossrefs_per_article: int
    max_context_chunks: int
    max_tokens: int


# Retrieval depth per mode.
PROFILES = {"user": Profile(5, 3, 2, 12, 2048), "lawyer": Profile(8, 5, 4, 20, 4096)}
DEFAULT_MODE = "user"


@dataclass(frozen=True)
class RouteConfig:
    """Bounds of the article numbers that a question may name."""

    total_articles: int = 298
    max_span: int = 50
    global_row_cap: int = 100
    index_labels: tuple[str, ...] = field(default=("Article", "ArticleSegment", "Definition"))
