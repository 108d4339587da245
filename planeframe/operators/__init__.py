"""The five dataflow operators: Project, Filter, Join, Fuse and Compose, each from lazy frames to a lazy frame."""

from .dataflow import compose_evidence, filter_rows, fuse, join_pairs, join_rows, project
from .relation import EVIDENCE, Relation, evidence_frame, with_order

__all__ = ["EVIDENCE", "Relation", "compose_evidence", "evidence_frame", "filter_rows", "fuse", "join_pairs", "join_rows", "project", "with_order"]
