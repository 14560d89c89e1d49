"""What the engine raises."""

from __future__ import annotations


class UnsupportedExprError(Exception):
    """An expression has no form in a back end."""


class UnsupportedSqlExprError(UnsupportedExprError):
    """Strict mode only: an expression that engines with a linear-time regex matcher would refuse."""


class FieldNotProjectedError(LookupError):
    """A row was asked for a field that its reader didn't project."""


class FieldNotDissectedError(LookupError):
    """A dissector was asked for a field that it doesn't know, so that its absence would say nothing."""


class DissectorError(RuntimeError):
    """The dissector process failed."""


class DissectorNotFoundError(DissectorError):
    """There is no such dissector program."""


class WorkspaceError(Exception):
    """A workspace can't do this."""


class WorkspaceModeError(WorkspaceError):
    """A write on a workspace that is open for reading."""


class WorkspaceAliasError(WorkspaceError):
    """An attachment's name is invalid, taken or unknown."""


class SchemaVersionError(WorkspaceError):
    """The workspace has another layout version."""


class ColumnNameCollisionError(WorkspaceError):
    """Two fields would have one column."""


class MaterializationMismatchError(WorkspaceError):
    """The workspace holds another materialization than the one asked for."""


class FieldNotMaterializedError(WorkspaceError):
    """A query names fields that the workspace doesn't hold."""


class FieldDeclarationMismatchError(WorkspaceError):
    """A query declares a field otherwise than the workspace."""


class MissingStreamFieldsError(WorkspaceError):
    """Sessionization lacks fields: ``missing``."""

    def __init__(self, missing: tuple[str, ...]):
        super().__init__(f"streams can't be built without {', '.join(missing)}: materialize these fields first")
        self.missing = missing
