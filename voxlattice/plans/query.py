"""The lazy query: built step by step, checked and planned when it runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxlattice.errors import Cancelled, SpatialError
from voxlattice.frame import AXES, VoxelFrame
from voxlattice.operators import transforms
from voxlattice.operators.lookups import Range, get_overlapping
from voxlattice.operators.policies import MergePolicy
from voxlattice.plans import nodes, optimizer
from voxlattice.plans.nodes import Demand, Node, Unary


class Query:
    """``Query.of(frame).zoom_out(22, MAX).falloff_x(...).run()``; every step gives a new query."""

    def __init__(self, node: Node):
        self.node = node

    @staticmethod
    def of(source: VoxelFrame | Any, name: str = "frame") -> Query:
        return Query(nodes.Source(source, name))

    def then(self, op: nodes.UnaryOp) -> Query:
        """Any step, also of your own class. A bad parameter fails the query when it runs, not here."""
        if isinstance(self.node, nodes.Failed):
            return self
        try:
            op.validate()
        except SpatialError as e:
            return Query(nodes.Failed(e))
        return Query(Unary(op, self.node))

    def with_other(self, op: nodes.BinaryOp, other: Query) -> Query:
        for q in (self, other):
            if isinstance(q.node, nodes.Failed):
                return q
        return Query(nodes.Binary(op, self.node, other.node))

    # Steps -----------------------------------------------------------------------------------------------------------

    def shift_f(self, z: int, n: int) -> Query:
        return self.then(nodes.Shift("f", z, n))

    def shift_x(self, z: int, n: int) -> Query:
        return self.then(nodes.Shift("x", z, n))

    def shift_y(self, z: int, n: int) -> Query:
        return self.then(nodes.Shift("y", z, n))

    def extrude_f(self, z: int, a: int, b: int, policy: MergePolicy) -> Query:
        return self.then(nodes.Extrude("f", z, a, b, policy))

    def extrude_x(self, z: int, a: int, b: int, policy: MergePolicy) -> Query:
        return self.then(nodes.Extrude("x", z, a, b, policy))

    def extrude_y(self, z: int, a: int, b: int, policy: MergePolicy) -> Query:
        return self.then(nodes.Extrude("y", z, a, b, policy))

    def falloff_f(self, z: int, r: int, direction: str, pattern: transforms.Pattern, policy: MergePolicy) -> Query:
        return self.then(nodes.Falloff("f", z, r, direction, pattern, policy))

    def falloff_x(self, z: int, r: int, direction: str, pattern: transforms.Pattern, policy: MergePolicy) -> Query:
        return self.then(nodes.Falloff("x", z, r, direction, pattern, policy))

    def falloff_y(self, z: int, r: int, direction: str, pattern: transforms.Pattern, policy: MergePolicy) -> Query:
        return self.then(nodes.Falloff("y", z, r, direction, pattern, policy))

    def zoom_out(self, z: int, policy: MergePolicy, weight: str = "cell") -> Query:
        return self.then(nodes.ZoomOut(z, policy, weight))

    def filter_values(self, predicate: transforms.ValuePredicate) -> Query:
        return self.then(nodes.FilterValues(predicate))

    def filter_eq(self, v: Any) -> Query:
        return self.filter_values(transforms.equals(v))

    def filter_in(self, low: Any = None, high: Any = None) -> Query:
        return self.filter_values(transforms.inside(low, high))

    def filter_not_in(self, low: Any = None, high: Any = None) -> Query:
        return self.filter_values(transforms.outside(low, high))

    def map_values(self, fn: Callable[[Column], Column]) -> Query:
        return self.then(nodes.MapValues(fn))

    def merge(self, other: Query, default: Any, policy: MergePolicy) -> Query:
        return self.with_other(nodes.Merge(default, policy), other)

    def intersection(self, other: Query) -> Query:
        return self.with_other(nodes.Intersection(), other)

    def difference(self, other: Query) -> Query:
        return self.with_other(nodes.Difference(), other)

    # Running ---------------------------------------------------------------------------------------------------------

    def validate(self) -> None:
        optimizer.validate(self.node)

    def run(self) -> VoxelFrame:
        self.validate()
        return optimizer.optimize(self.node).lower(None)

    def raw_run(self) -> VoxelFrame:
        """As written: no checks, no reordering."""
        return self.node.lower(None)

    def run_set(self) -> VoxelFrame:
        return self.run().without_values()

    def run_within(self, targets: list[Range]) -> VoxelFrame:
        """The result in the targets' region only; the scan reads what that needs. Clipped to the region."""
        self.validate()
        if not targets:
            out = self.run()
            return out.over(out.df.limit(0))
        out = optimizer.optimize(self.node).lower(Demand.of(targets))
        return get_overlapping(out, targets)

    def lazy_get(self, target: Range) -> VoxelFrame:
        return self.run_within([target])

    def lazy_get_with_default(self, target: Range, default: Any) -> VoxelFrame:
        """Every cell of the target (at the finer zoom of target and result), ``default`` where the result has none."""
        found = self.lazy_get(target)
        z = max(found.z, target.z)
        found = found.refine(z)
        found = get_overlapping(found, [target])
        spark = found.df.sparkSession
        cells = spark.range(1)
        for a in AXES:
            runs = F.flatten(F.array(*[F.sequence(F.lit(s), F.lit(e - 1)) for s, e in target.spans(a, z)]))
            cells = cells.withColumn(a, F.explode(runs.cast("array<int>")))
        out = cells.drop("id").join(found.df, list(AXES), "left")
        return found.over(out.withColumn("value", F.coalesce(F.col("value"), F.lit(default))))

    def explain(self) -> str:
        return optimizer.explain(self.node)

    def explain_optimized(self) -> str:
        return optimizer.explain(optimizer.optimize(self.node))


class CancellationToken:
    """Cancels the Spark jobs of what runs under it, from any thread."""

    def __init__(self, spark):
        self.context, self.group, self.cancelled = spark.sparkContext, f"query-{uuid.uuid4().hex}", False

    def cancel(self) -> None:
        self.cancelled = True
        self.context.cancelJobGroup(self.group)

    def run(self, action: Callable[[], Any]) -> Any:
        """The action's result; ``Cancelled`` if the token is or gets cancelled."""
        if self.cancelled:
            raise Cancelled("cancelled before it began")
        self.context.setJobGroup(self.group, "spatial query", interruptOnCancel=True)
        try:
            return action()
        except Exception as e:
            if self.cancelled:
                raise Cancelled("cancelled") from e
            raise
        finally:
            self.context.setLocalProperty("spark.jobGroup.id", None)


def query(frame: VoxelFrame, name: str = "frame") -> Query:
    return Query.of(frame, name)


