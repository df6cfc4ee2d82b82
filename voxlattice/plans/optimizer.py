"""Rewrites that Catalyst cannot make: no-ops go, commuting steps run in order of how much they multiply.

Runs of consecutive steps that all commute with each other form a group; within it the cheapest expansion comes
first. Order is changed only where results stay exactly equal: shifts among each other, cyclic shifts with falloffs, extrudes
of different axes under one commutative policy.
"""

from __future__ import annotations

from voxlattice.plans.nodes import Binary, Node, Unary, UnaryOp


def _chain(node: Node) -> tuple[list[UnaryOp], Node]:
    """The steps above the first node that is not unary, in order of execution."""
    ops: list[UnaryOp] = []
    while isinstance(node, Unary):
        ops.append(node.op)
        node = node.input
    return ops[::-1], node


def commuting_groups(ops: list[UnaryOp]) -> list[list[UnaryOp]]:
    groups: list[list[UnaryOp]] = []
    for op in ops:
        if groups and all(op.commutes(o) and o.commutes(op) for o in groups[-1]):
            groups[-1].append(op)
        else:
            groups.append([op])
    return groups


def ordered(ops: list[UnaryOp]) -> list[UnaryOp]:
    return [op for group in commuting_groups(ops) for op in sorted(group, key=lambda o: o.expansion())]


def optimize(node: Node) -> Node:
    ops, below = _chain(node)
    if isinstance(below, Binary):
        below = Binary(below.op, optimize(below.left), optimize(below.right))
    for op in ordered([o for o in ops if not o.is_noop()]):
        below = Unary(op, below)
    return below


def validate(node: Node) -> None:
    for child in node.children():
        validate(child)
    node.validate()


def explain(node: Node, depth: int = 0) -> str:
    """The tree, one step a line, inputs indented below."""
    return "\n".join(["  " * depth + node.text(), *(explain(c, depth + 1) for c in node.children())])
