"""Plans: typed operations, their JSON form, and static validation."""

from .codec import plan_from_dict, plan_from_json, plan_to_dict, plan_to_json
from .operations import (
    ApplyMutation,
    Binding,
    Compose,
    Describe,
    Discover,
    Filter,
    Fuse,
    InvokeSkill,
    Join,
    Plan,
    Project,
    ProposeMutation,
    Query,
    Recall,
    Ref,
    ResolveSkill,
    Search,
    Traverse,
)
from .validation import Issue, topological_order, validate

__all__ = [
    "ApplyMutation", "Binding", "Compose", "Describe", "Discover", "Filter", "Fuse", "InvokeSkill", "Issue", "Join", "Plan", "Project", "ProposeMutation", "Query", "Recall", "Ref",
    "ResolveSkill", "Search", "Traverse", "plan_from_dict", "plan_from_json", "plan_to_dict", "plan_to_json", "topological_order", "validate",
]
