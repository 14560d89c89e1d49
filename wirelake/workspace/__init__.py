"""Workspaces: a capture that is dissected once and then queried as columns."""

from wirelake.workspace.catalog import CacheKey, Catalog, FieldRecord, cache_key, fingerprint
from wirelake.workspace.workspace import Annotation, MaterializeResult, StreamsResult, Workspace

__all__ = ["Annotation", "CacheKey", "Catalog", "FieldRecord", "MaterializeResult", "StreamsResult", "Workspace", "cache_key", "fingerprint"]
