"""Chains of lazy operators over entities.

A set is a DataFrame with an order.  Positions (first, eq, take and so on) are
counted within each document.  Sorts are stable: a sort's keys go before the
order there was.  Nothing runs before a result is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import js
from ..plans import selector as sel
from ..sources.schema import FIELDS, META
from . import mutate, render

Predicate = str | Column | Callable[[DataFrame], Column]
_MISSING = object()


@dataclass(frozen=True)
class EntitySet:
    """Entities and their order (columns, each ascending or descending); the changes made are in the rows' log.

    ``origin`` is the set with changes that this one is derived from, ``calls``
    counts the changing calls behind it and ``document`` is what it belongs to.
    """

    df: DataFrame
    order: tuple[tuple[str, bool], ...] = (("ord", True),)
    origin: EntitySet | None = None
    calls: int = 0
    document: Any = None

    # Helpers

    def _sorting(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in self.order]

    def _window(self) -> Any:
        return Window.partitionBy("doc_id").orderBy(*self._sorting())

    def _ranked(self, name: str = "__rn") -> DataFrame:
        return self.df.withColumn(name, F.row_number().over(self._window()))

    def _of(self, df: DataFrame, order: tuple[tuple[str, bool], ...] | None = None) -> EntitySet:
        return EntitySet(df.drop(mutate.LOG), order or self.order, self._versioned(), self.calls, self.document)

    def _versioned(self) -> EntitySet | None:
        return self if mutate.LOG in self.df.columns else self.origin

    def next_seq(self) -> int:
        """The number of the next logged change."""
        return 1000 * (self.calls + 1)

    def changed_to(self, df: DataFrame) -> EntitySet:
        """This set with other rows and their longer log."""
        return replace(self, df=df, calls=self.calls + 1)

    @property
    def version(self) -> int:
        """1 and one more for each call that changed anything; counts the logs, so it runs jobs where there are any."""
        before = self.origin.version if self.origin is not None else getattr(self.document, "version", 1)
        if mutate.LOG not in self.df.columns:
            return before
        return before + mutate.changes_of(self.df).select(F.floor(F.col("seq") / 1000)).distinct().count()

    def get_doc(self) -> Any:
        """The compiled document that this set was made of, if it was."""
        return self.document

    def _condition(self, p: Predicate) -> Column:
        if isinstance(p, str):
            return sel.compound(p, self.df.columns)
        return p if isinstance(p, Column) else p(self.df)

    def ordered(self) -> DataFrame:
        """The entities by document and place; helper columns are dropped."""
        df = self.df.orderBy("doc_id", *self._sorting())
        return df.drop(*(c for c in df.columns if c.startswith("__")))

    def arranged(self) -> DataFrame:
        """The entities in place within their document; a document is in one partition, documents come in no order."""
        return self.df.repartition("doc_id").sortWithinPartitions("doc_id", *self._sorting())

    # Selection

    def select(self, selector: Predicate | None = None) -> EntitySet:
        """The entities that a selector, predicate or Column picks."""
        if selector is not None and not isinstance(selector, str):
            return self._of(self.df.where(self._condition(selector)))
        branches = sel.parse(selector)
        if branches is None:
            return self
        if not branches:
            return self._of(self.df.where(F.lit(False)))
        if len(branches) == 1:
            return self._of(self._branch(branches[0]).df)
        if all(b.index is None for b in branches):  # one scan: each row has the first branch that it matches
            number = F.coalesce(*(F.when(sel.predicate(b.parts, self.df.columns), i) for i, b in enumerate(branches)))
            found = self.df.withColumn("__branch", number).where("__branch is not null")
        else:
            found = None
            for i, b in enumerate(branches):
                part = self._branch(b).df.withColumn("__branch", F.lit(i))
                found = part if found is None else found.unionByName(part)
        key = Window.partitionBy("doc_id", "id").orderBy("__branch", *self._sorting())
        once = found.withColumn("__rn", F.row_number().over(key)).where("__rn = 1").drop("__rn")
        name = f"__b{len(self.order)}"
        return self._of(once.withColumnRenamed("__branch", name), ((name, True), *self.order))

    def _branch(self, b: sel.Branch) -> EntitySet:
        found = self._of(self.df.where(sel.predicate(b.parts, self.df.columns)))
        if b.index is None:
            return found
        n = b.index.n
        return {
            "first": lambda: found._places(F.col("__rn") <= 1), "last": found._last, "eq": lambda: found.eq(n), "gt": lambda: found._places(F.col("__rn") > n + 1),
            "lt": lambda: found._places(F.col("__rn") <= n), "even": lambda: found._places(F.pmod("__rn", F.lit(2)) == 1), "odd": lambda: found._places(F.pmod("__rn", F.lit(2)) == 0),
        }[b.index.kind]()

    def _places(self, condition: Column) -> EntitySet:
        return self._of(self._ranked().where(condition).drop("__rn"))

    def _last(self, n: int = 1) -> EntitySet:
        back = [F.col(c).desc_nulls_last() if up else F.col(c).asc_nulls_first() for c, up in self.order]
        return self._of(self.df.withColumn("__rn", F.row_number().over(Window.partitionBy("doc_id").orderBy(*back))).where(F.col("__rn") <= n).drop("__rn"))

    # Filters

    def filter(self, p: Predicate) -> EntitySet:
        """Those that match one compound selector or predicate."""
        return self._of(self.df.where(self._condition(p)))

    def not_(self, p: Predicate) -> EntitySet:
        """Those that don't."""
        return self._of(self.df.where(~F.coalesce(self._condition(p), F.lit(False))))

    def contains(self, text: str) -> EntitySet:
        """Those whose text isn't empty and has this part, whatever the case."""
        return self._of(self.df.where((F.col("text") != "") & F.contains(F.lower("text"), F.lit(text.lower()))))

    def matches(self, pattern: str, ignore_case: bool = False) -> EntitySet:
        """Those whose text isn't empty and has a match of the pattern."""
        return self._of(self.df.where((F.col("text") != "") & F.col("text").rlike(js.java_pattern(pattern, ignore_case))))

    def on_page(self, page: int) -> EntitySet:
        """Those of a page, counted from 1."""
        return self._of(self.df.where(F.col("page_index") == page - 1))

    def in_table(self, table_id: str) -> EntitySet:
        """The cells of a table."""
        return self._of(self.df.where(F.col("table_id") == table_id))

    def by_id(self, entity_id: str) -> EntitySet:
        """All entities with this id."""
        return self._of(self.df.where(F.col("id") == entity_id))

    def query_page(self, page: int) -> EntitySet:
        """The entities of a page, as a set to query."""
        return self.on_page(page)

    def query_pages(self, pages: list[int]) -> EntitySet:
        """The entities of some pages, in document order."""
        return self._of(self.df.where(F.col("page_index").isin([p - 1 for p in pages])))

    def take(self, n: int) -> EntitySet:
        """The first n; with a negative n all but the last."""
        return self._places(F.col("__rn") <= n) if n >= 0 else self._but_last(-n)

    def skip(self, n: int) -> EntitySet:
        """All but the first n; with a negative n the last."""
        return self._places(F.col("__rn") > n) if n >= 0 else self._last(-n)

    def _but_last(self, n: int) -> EntitySet:
        return self._of(self._ranked().withColumn("__n", F.count("*").over(Window.partitionBy("doc_id"))).where(F.col("__rn") <= F.col("__n") - n).drop("__rn", "__n"))

    def eq(self, i: int) -> EntitySet:
        """The one at a place, from 0; none if there is no such place."""
        return self._places(F.col("__rn") == i + 1)

    def first(self) -> Row | None:
        """The first entity of the first document."""
        return self.ordered().head()

    def last(self) -> Row | None:
        """The last entity of the first document."""
        return self._of(self._last().df).ordered().head()

    # Sorts

    def sort_by(self, key: str | Column | Callable[[DataFrame], Column], descending: bool = False) -> EntitySet:
        """Ascending by a column; text as a dictionary orders it, nulls as the text 'undefined'."""
        c = F.col(key) if isinstance(key, str) else key if isinstance(key, Column) else key(self.df)
        name = f"__s{len(self.order)}"
        df = self.df.withColumn(name, c)
        if df.schema[name].dataType.typeName() == "string":
            df = df.withColumn(name, F.collate(F.coalesce(name, F.lit("undefined")), "UNICODE"))
        return self._of(df, ((name, not descending), *self.order))

    def sort_by_confidence(self) -> EntitySet:
        """Descending by confidence."""
        return self.sort_by("confidence", descending=True)

    def sort_by_position(self, tolerance: float = 0.01) -> EntitySet:
        """By rows of text, then from left to right, whatever the page.

        A row of text ends where the next entity is more than ``tolerance`` below.
        """
        w = Window.partitionBy("doc_id").orderBy(F.col("bbox.ymin"), *self._sorting())
        gap = F.col("bbox.ymin") - F.lag("bbox.ymin").over(w) > tolerance
        k = len(self.order)
        df = self.df.withColumn("__gap", F.coalesce(gap.cast("int"), F.lit(0))).withColumn(f"__r{k}", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__gap")
        return self._of(df.withColumn(f"__x{k}", F.col("bbox.xmin")), ((f"__r{k}", True), (f"__x{k}", True), *self.order))

    # Aggregates: DataFrames, over everything or by the given columns

    def stats(self, *by: str) -> DataFrame:
        """Total, counts by status, score and mean confidence."""
        total, verified = F.count("ord"), F.count_if(F.col("verification_status") == "verified")
        return self.df.groupBy(*by).agg(
            total.alias("total"), verified.alias("verified"), F.count_if(F.col("verification_status") == "flagged").alias("flagged"), F.count_if(F.col("verification_status") == "pending").alias("pending"),
            F.when(total > 0, verified / total).otherwise(0.0).alias("score"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"),
        )

    def sum(self, *by: str) -> DataFrame:
        """Sum of values; 0 if there are none."""
        return self.df.groupBy(*by).agg(F.coalesce(F.sum("value_num"), F.lit(0.0)).alias("sum"))

    def avg(self, *by: str) -> DataFrame:
        """Mean of values; 0 if there are none."""
        return self.df.groupBy(*by).agg(F.coalesce(F.avg("value_num"), F.lit(0.0)).alias("avg"))

    def min(self, *by: str) -> DataFrame:
        """Least value."""
        return self.df.groupBy(*by).agg(F.min("value_num").alias("min"))

    def max(self, *by: str) -> DataFrame:
        """Greatest value."""
        return self.df.groupBy(*by).agg(F.max("value_num").alias("max"))

    def count(self) -> int:
        """Number of entities."""
        return self.df.count()

    @property
    def length(self) -> int:
        """Number of entities."""
        return self.count()

    def count_by_type(self) -> DataFrame:
        """Entities of each type, in order of first appearance."""
        return self._counted("type")

    def count_by_page(self) -> DataFrame:
        """Entities of each page, counted from 1."""
        return EntitySet(self.df.withColumn("page", F.col("page_index") + 1), self.order)._counted("page")

    def _counted(self, key: str) -> DataFrame:
        return self.df.groupBy(key).agg(F.count("*").alias("count"), F.min(F.struct("doc_id", *(c for c, _ in self.order))).alias("__first")).orderBy("__first").drop("__first")

    def group_by(self, key: str | Column | Callable[[DataFrame], Column], name: str = "key", **aggregates: Column) -> DataFrame:
        """Aggregates by a key (count by default), in order of first appearance; a null key is a group."""
        c = F.col(key) if isinstance(key, str) else key if isinstance(key, Column) else key(self.df)
        found = aggregates or {"count": F.count("*")}
        first = F.min(F.struct("doc_id", *(k for k, _ in self.order)))
        return self.df.withColumn("__key", c).groupBy("__key").agg(*(v.alias(k) for k, v in found.items()), first.alias("__first")).orderBy("__first").drop("__first").withColumnRenamed("__key", name)

    def groups(self, key: str | Column | Callable[[DataFrame], Column]) -> Groups:
        """The groups of a key, each a set to query."""
        c = F.col(key) if isinstance(key, str) else key if isinstance(key, Column) else key(self.df)
        return Groups(self, c)

    def groups_by_page(self) -> Groups:
        """By page, counted from 1."""
        return self.groups(F.col("page_index") + 1)

    def groups_by_type(self) -> Groups:
        """By type."""
        return self.groups("type")

    def group_by_page(self, **aggregates: Column) -> DataFrame:
        """By page, counted from 1."""
        return self.group_by(F.col("page_index") + 1, "page", **aggregates)

    def group_by_type(self, **aggregates: Column) -> DataFrame:
        """By type."""
        return self.group_by("type", "type", **aggregates)

    def reduce(self, step: Callable[[Column, Column], Column], start: Column, *by: str) -> DataFrame:
        """Left fold in order; ``step`` gets the state and the entity as a struct."""
        entity = F.struct(*(c for c in self.df.columns if not c.startswith("__") and c not in ("extra", "data")))
        df = self.df.withColumn("__rn", F.row_number().over(Window.partitionBy(*(by or ("doc_id",))).orderBy(*self._sorting()))).select(*by, F.struct("__rn", entity.alias("e")).alias("__e"))
        return df.groupBy(*by).agg(F.aggregate(F.array_sort(F.collect_list("__e")), start, lambda s, x: step(s, x["e"])).alias("result"))

    def some(self, p: Predicate, *by: str) -> DataFrame:
        """Whether any matches."""
        return self.df.groupBy(*by).agg(F.coalesce(F.bool_or(F.coalesce(self._condition(p), F.lit(False))), F.lit(False)).alias("some"))

    def every(self, p: Predicate, *by: str) -> DataFrame:
        """Whether all match."""
        return self.df.groupBy(*by).agg(F.coalesce(F.bool_and(F.coalesce(self._condition(p), F.lit(False))), F.lit(True)).alias("every"))

    # Access

    def text(self) -> str | None:
        """Text of the first entity."""
        row = self.ordered().select("text").head()
        return row and row.text

    def _column(self, *names: str) -> list[Any]:
        df = self.ordered()
        return [r[0] if len(names) == 1 else tuple(r) for r in df.select(*names).collect()]

    def texts(self) -> list[str]:
        """Texts in order."""
        return self._column("text")

    def values(self) -> list[Any]:
        """Values in order; None where there is none."""
        return [a if a is not None else b for a, b in self._column("value_num", "value_str")]

    def ids(self) -> list[str]:
        """Ids in order."""
        return self._column("id")

    def types(self) -> list[str]:
        """Types in order."""
        return self._column("type")

    def each(self, f: Callable[[Row], Any]) -> EntitySet:
        """Calls a function on every entity in order, on the driver, row by row."""
        for row in self.ordered().toLocalIterator():
            f(row)
        return self

    def map(self, f: Callable[[DataFrame], Column], name: str = "value") -> DataFrame:
        """A column made of every entity, in order within documents."""
        return replace(self, df=self.df.withColumn("__v", f(self.df))).arranged().select("doc_id", F.col("__v").alias(name))

    def find(self, p: Column | Callable[[DataFrame], Column]) -> Row | None:
        """The first that a predicate holds for."""
        return self._of(self.df.where(self._condition(p))).first()

    def to_array(self) -> list[Row]:
        """All entities, in order."""
        return self.ordered().collect()

    def items(self) -> DataFrame:
        """Entities in the shape of query results, in order within documents."""
        position = F.when(F.col("row_index").isNotNull(), F.struct(F.col("row_index").alias("row"), F.coalesce("col_index", F.lit(0)).alias("col")))
        value = F.coalesce(js.number_text(F.col("value_num")), F.col("value_str")) if "value_str" in self.df.columns else js.number_text(F.col("value_num"))
        return self.arranged().select(
            "doc_id", "id", "type", "text", value.alias("value"), (F.col("page_index") + 1).alias("page"), "bbox", "confidence", F.col("verification_status").alias("status"), F.col("table_id").alias("tableId"), position.alias("position")
        )

    # Attributes and data

    def attr(self, key: str | dict[str, Any], value: Any = _MISSING, timestamp: int = 0) -> Any:
        """The first entity's attribute; with a value, or a dict, a set with the attributes changed and logged."""
        if isinstance(key, str) and (value is _MISSING or value is None):
            row = self.first()
            return None if row is None else mutate.attribute(row, key)
        return mutate.set_attributes(self, key if isinstance(key, dict) else {key: value}, timestamp)

    def remove_attr(self, key: str | list[str], timestamp: int = 0) -> EntitySet:
        """A set without these metadata; entity fields are logged but stay."""
        return mutate.remove_attributes(self, [key] if isinstance(key, str) else key, timestamp)

    def toggle_attr(self, key: str, force: bool | None = None, timestamp: int = 0) -> EntitySet:
        """A set with a boolean negated row by row, or forced."""
        return mutate.toggle(self, key, force, timestamp)

    def data(self, key: str | dict[str, Any], value: Any = _MISSING) -> Any:
        """The first entity's datum, else its metadata; with a value, or a dict, a set with data added."""
        if isinstance(key, str) and (value is _MISSING or value is None):
            row = self.first()
            return None if row is None else mutate.datum(row, key)
        return mutate.set_data(self, key if isinstance(key, dict) else {key: value})

    def changes(self) -> DataFrame:
        """The log of this set's changes; derived sets begin a new one."""
        return mutate.changes_of(self.df)

    def has_changes(self) -> bool:
        """Whether anything was changed."""
        return mutate.LOG in self.df.columns and not self.changes().isEmpty()

    def clear_changes(self) -> EntitySet:
        """The same set with an empty log."""
        return replace(self, df=self.df.drop(mutate.LOG), origin=self._versioned())

    def mutation_log(self) -> DataFrame:
        """The log with the document version and the time of the request."""
        return self.changes().withColumn("doc_version", F.lit(self.version)).withColumn("created_at", F.unix_millis(F.current_timestamp()))

    # Rendering

    def json(self) -> DataFrame:
        """One JSON array of each document's entities."""
        return render.json_arrays(self)

    def html(self, **options: Any) -> DataFrame:
        """HTML of each document's entities."""
        return render.html(self, render.RenderOptions(**options))

    def html_by_page(self, **options: Any) -> DataFrame:
        """HTML of each document, in pages in order of first appearance."""
        return render.html_by_page(self, render.RenderOptions(**options))

    def html_document(self, title: str = "Document", **options: Any) -> DataFrame:
        """A whole HTML page for each document."""
        return render.html_document(self, render.RenderOptions(**options), title)

    def markdown(self, transform: Callable[[Row, dict[str, Any]], dict[str, Any] | None] | None = None, image_url: str | None = None, force: bool = False, **options: Any) -> tuple[str, EntitySet]:
        """Markdown of the first entity and the set with the transformation kept in its data.

        A kept transformation is returned unless forced; without an image, or if
        the transformation fails, the text is.
        """
        return mutate.markdown(self, transform, image_url, force, options)


@dataclass(frozen=True)
class Groups:
    """The groups of a set; the keys come to the driver when they are asked for, the groups' entities don't."""

    whole: EntitySet
    key: Column

    def keys(self) -> list[Any]:
        """Keys in order of first appearance; a null key is one."""
        first = F.min(F.struct("doc_id", *(k for k, _ in self.whole.order)))
        return [r[0] for r in self.whole.df.withColumn("__key", self.key).groupBy("__key").agg(first.alias("__first")).orderBy("__first").select("__key").collect()]

    def __getitem__(self, key: Any) -> EntitySet:
        return self.whole._of(self.whole.df.where(self.key.eqNullSafe(F.lit(key))))

    def __iter__(self) -> Iterator[Any]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self.keys())

    def items(self) -> list[tuple[Any, EntitySet]]:
        """Keys with their sets."""
        return [(k, self[k]) for k in self.keys()]

    def take(self, n: int) -> EntitySet:
        """The first n of every group of each document, in one window whatever the number of groups."""
        w = Window.partitionBy("doc_id", "__key").orderBy(*self.whole._sorting())
        df = self.whole.df.withColumn("__key", self.key).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn", "__key")
        return self.whole._of(df)


def attribute_names() -> list[str]:
    """Names that selectors resolve without custom metadata."""
    return [*META, *FIELDS]
