"""Row types, vocabularies and the zoom bands of the knowledge graph."""

from __future__ import annotations

from dataclasses import dataclass

NODES = "id string, kind string, name string, qualified_name string, file_path string, data string, tier string, created_at string, updated_at string"
EDGES = "id string, source_id string, target_id string, relation string, data string, created_at string"
ANNOTATIONS = "id string, decision_id string, edge_id string, created_at string"
INDEX_PROJECTS = "name string, indexed_at string, root_path string"
INDEX_NODES = "id long, project string, label string, name string, qualified_name string, file_path string, start_line int, end_line int, properties string"
INDEX_EDGES = "id long, project string, source_id long, target_id long, type string, properties string"
EVENTS = "id string, kind string, actor string, created_at long, project_id string, payload string"
MUTATIONS = "seq long, pos int, op string, id string, kind string, name string, status string, data string, source_id string, target_id string, relation string"

#: What a decision's and an event's JSON holds.
DECISION_DATA = "description string, rationale string, alternatives array<struct<name:string,reason_rejected:string>>, status string, superseded_by string, created_by string, author string"
EVENT_PAYLOAD = (
    "decision_id string, title string, rationale string, governed_file_ids array<string>, tags array<string>, changed_fields array<string>, old_id string, new_id string, "
    "reason string, from_tier string, to_tier string, would_govern_file_ids array<string>, hash string, message string, files array<struct<path:string,status:string>>, decision_links array<string>"
)
#: Labels of the code index, lower-cased, by the kind they become; any other one stays.
LABEL_KINDS = {"function": "function", "method": "function", "class": "component", "module": "component", "interface": "component", "file": "path", "package": "path", "folder": "path"}
TRACED = ("CALLS", "IMPORTS")
TIERS = ("personal", "team", "public")
STATUSES = ("active", "superseded", "deprecated")
KINDS = ("decision", "file", "function", "component", "reference", "path", "variable", "section", "type", "project")


@dataclass(frozen=True)
class Band:
    """What a range of zoom shows. No depth means any."""

    below: float
    kinds: tuple[str, ...]
    depth: int | None
    dirs: bool
    files: bool
    leaf_files: bool


BANDS = (
    Band(0.4, ("decision",), 2, True, False, False),
    Band(1.0, ("decision",), 3, True, False, False),
    Band(2.0, ("decision", "file"), None, False, True, True),
    Band(float("inf"), KINDS, None, False, False, True),
)


def band_for(zoom: float) -> Band:
    return next((b for b in BANDS if zoom < b.below), BANDS[-1])
