"""The relational dataset contract: tables, keys, time columns and prediction tasks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

# logical column types (fixed values)
FLOAT = "float"
CATEGORY = "category"
DATETIME = "datetime"
TEXT = "text"
TIMESTAMP = "timestamp"
PRIMARY_KEY = "primary_key"
FOREIGN_KEY = "foreign_key"
TOKENS = "tokens"
DTYPES = (FLOAT, CATEGORY, DATETIME, TEXT, TIMESTAMP, PRIMARY_KEY, FOREIGN_KEY, TOKENS)


@dataclass(frozen=True)
class ColumnMeta:
    name: str
    dtype: str
    link_to: str | None = None  # "table.column" for foreign keys
    in_size: int = 1  # > 1 for fixed-width vectors

    def __post_init__(self):
        if self.dtype not in DTYPES:
            raise ValueError(f"unknown logical dtype {self.dtype!r}")

    @property
    def is_key(self) -> bool:
        return self.dtype in (PRIMARY_KEY, FOREIGN_KEY)

    @property
    def is_vector(self) -> bool:
        return self.in_size > 1


@dataclass(frozen=True)
class ForeignKey:
    child: str
    fk: str
    parent: str
    pk: str


@dataclass(frozen=True)
class TableMeta:
    name: str
    columns: tuple[ColumnMeta, ...]
    time_column: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        names = [c.name for c in self.columns]
        if len(names) != len(set(names)):
            raise ValueError(f"duplicate column in table {self.name}")
        if self.time_column and self.time_column not in names:
            raise ValueError(f"time column {self.time_column} is not in table {self.name}")

    def column(self, name: str) -> ColumnMeta:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"{self.name}.{name}")

    @property
    def primary_keys(self) -> list[str]:
        return [c.name for c in self.columns if c.dtype == PRIMARY_KEY]

    @property
    def foreign_keys(self) -> list[str]:
        return [c.name for c in self.columns if c.dtype == FOREIGN_KEY]

    @property
    def primary_key(self) -> str | None:
        keys = self.primary_keys
        if len(keys) > 1:
            raise ValueError(f"more than one primary key in {self.name}: {keys}")
        return keys[0] if keys else None


@dataclass(frozen=True)
class TaskMeta:
    name: str
    target_table: str
    target_column: str | None = None
    keys: tuple[str, ...] = ()
    time_column: str | None = None
    task_type: str = "classification"
    metric: str = "auroc"


@dataclass
class RelationalDataset:
    """Lazy DataFrames plus metadata; nothing here is data-sized on the driver."""

    name: str
    tables: dict[str, DataFrame]
    meta: dict[str, TableMeta]
    column_groups: list[list[tuple[str, str]]] = field(default_factory=list)
    tasks: dict[str, tuple[TaskMeta, DataFrame]] = field(default_factory=dict)

    def relationships(self) -> list[ForeignKey]:
        out = []
        for table in self.meta.values():
            for c in table.columns:
                if c.dtype == FOREIGN_KEY and c.link_to:
                    parent, pk = c.link_to.split(".", 1)
                    out.append(ForeignKey(table.name, c.name, parent, pk))
        return out

    def forward(self, table: str) -> list[ForeignKey]:
        return [r for r in self.relationships() if r.child == table]

    def backward(self, table: str) -> list[ForeignKey]:
        return [r for r in self.relationships() if r.parent == table]

    def with_table(self, meta: TableMeta, df: DataFrame) -> RelationalDataset:
        return replace(
            self, tables={**self.tables, meta.name: df}, meta={**self.meta, meta.name: meta}
        )
