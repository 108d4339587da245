"""The five kinds of sources, over DataFrames with immutable versions."""

from .base import Source, SourceResult
from .document import DocumentSource
from .graph import GraphSource
from .memory import MemorySource
from .postings import Postings
from .skill import SkillSource, SkillSpec
from .stored import StoredDocuments, StoredMemory
from .table import TableSource
from .versions import Versions

__all__ = ["DocumentSource", "GraphSource", "MemorySource", "Postings", "SkillSource", "SkillSpec", "Source", "SourceResult", "StoredDocuments", "StoredMemory", "TableSource", "Versions"]
