"""Reading and writing behind an access decision: everything is narrowed to what it allows before limits are counted."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mnemos.functions.columns import NAMESPACE_IDS
from mnemos.operators.context import federated
from mnemos.operators.graph import local_graph, visible
from mnemos.operators.records import list_records, search_records


class AccessDenied(PermissionError):
    """A request that its decision doesn't allow. reason: why."""

    def __init__(self, reason: str):
        super().__init__(f"access denied: {reason}")
        self.reason = reason


class Gateway:
    """Tables as one decision (a row of access.decided) lets them be seen.

    Rows of records are seen if one of the decision's selectors fits their ids and their type is among its types; null lists allow all. A row that has none of the ids of a
    selector isn't seen by it. Lists and searches give at most the decision's max_results rows, counted from the first page on.
    """

    def __init__(self, decision: Row, ids: tuple = NAMESPACE_IDS):
        self.decision, self.ids = decision, ids

    def require(self) -> None:
        if not self.decision["allowed"]:
            raise AccessDenied(self.decision["reason"])

    def _fits(self) -> Column:
        spaces = self.decision["namespaces"]
        if spaces is None:
            return F.lit(True)
        of = lambda s: reduce(lambda a, b: a & b, (F.coalesce(F.col(i) == s[i], F.lit(False)) for i in self.ids if s[i] is not None), F.lit(True))
        return reduce(lambda a, b: a | b, map(of, spaces), F.lit(False))

    def seen(self, records: DataFrame) -> DataFrame:
        """The records that the decision allows at all."""
        types = self.decision["record_types"]
        out = records.where(self._fits())
        return out if types is None else out.where(F.col("type").isin(list(types)) if types else F.lit(False))

    def _page(self, limit: int | None, offset: int) -> int:
        most = self.decision["max_results"]
        left = None if most is None else max(0, most - offset)
        return limit if left is None else left if limit is None else min(limit, left)

    def get(self, records: DataFrame, record: str) -> DataFrame:
        """The record, or no row: a denied request doesn't tell whether there is one."""
        return self.seen(records).where((F.col("id") == record) & F.lit(bool(self.decision["allowed"])))

    def list(self, records: DataFrame, limit: int | None = None, offset: int = 0, **options) -> DataFrame:
        self.require()
        return list_records(self.seen(records), limit=self._page(limit, offset), offset=offset, **options)

    def search(self, records: DataFrame, query: str, limit: int | None = None, offset: int = 0, **options) -> DataFrame:
        self.require()
        return search_records(self.seen(records), query, limit=self._page(limit, offset), offset=offset, **options)

    def put(self, records: DataFrame, rows: DataFrame) -> DataFrame:
        """records after rows were put by id. Raises AccessDenied if one of the rows isn't to be seen."""
        self.require()
        if not rows.join(self.seen(rows).select("id"), "id", "left_anti").isEmpty():
            raise AccessDenied("selector_denied")
        return records.join(rows.select("id"), "id", "left_anti").select(*records.columns).unionByName(rows.select(*records.columns))

    def links(self, records: DataFrame, links: DataFrame, record: str, direction: str = "both", limit: int | None = None) -> DataFrame:
        """A record's links (link_id, source_record_id, target_record_id ..) whose ends are all seen, by link_id; none if it isn't seen itself."""
        self.require()
        ids = self.seen(records).select("id")
        near = links.where((F.col("source_record_id") == record) & F.lit(direction in ("out", "both")) | (F.col("target_record_id") == record) & F.lit(direction in ("in", "both")))
        near = near.join(ids.where(F.col("id") == record), F.lit(True), "left_semi")  # at most one row
        near = near.join(ids.withColumnRenamed("id", "source_record_id"), "source_record_id", "left_semi")
        ends = near.where("target_record_id is null").select(*links.columns).unionByName(near.join(ids.withColumnRenamed("id", "target_record_id"), "target_record_id", "left_semi").select(*links.columns))
        most = self._page(limit, 0)
        return ends.orderBy("link_id") if most is None else ends.orderBy("link_id").limit(most)

    def graph(self, records: DataFrame, edges: DataFrame, root: str, depth: int) -> tuple[DataFrame, DataFrame]:
        """(node_id, depth) around a record and the edges between these nodes, over records that are seen alone; nothing if the root isn't."""
        self.require()
        ids = self.seen(records).select(F.col("id").alias("node_id"))
        inside = visible(edges, ids)
        near = local_graph(inside, root, depth).join(ids, "node_id", "left_semi").orderBy("depth", "node_id")
        most = self._page(None, 0)
        near = near if most is None else near.limit(most)
        kept = visible(inside, near.select("node_id")).orderBy("edge_id")
        return near, kept if most is None else kept.limit(most)

    def federated(self, hits: DataFrame, limit: int) -> DataFrame:
        """Hits (workspace, position, id, score) of the workspaces that the decision allows. Raises AccessDenied if it allows none of them."""
        self.require()
        spaces = self.decision["workspace_ids"]
        mine = hits if spaces is None else hits.where(F.col("workspace").isin(list(spaces)) if spaces else F.lit(False))
        if spaces is not None and mine.isEmpty():
            raise AccessDenied("workspace_denied")
        most = self._page(limit, 0)
        return federated(mine, most)
