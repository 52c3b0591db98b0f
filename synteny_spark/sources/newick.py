"""Trees as text: Newick with [k=v:k=v] comments, the indented table format, and NHX gene trees."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"\s*(?:([(),;])|:\s*([-+0-9.eE]+)|\[(?:&&NHX:)?([^\]]*)\]|([^(),:;\[\s][^(),:;\[]*))")


@dataclass
class Node:
    name: str = ""
    length: float = 0.0
    tags: dict[str, str] = field(default_factory=dict)
    children: list["Node"] = field(default_factory=list)

    def walk(self):
        """Nodes in pre-order, each with its parent; without recursion."""
        todo = [(self, None)]
        while todo:
            node, parent = todo.pop()
            yield node, parent
            todo += [(c, node) for c in reversed(node.children)]


def parse(text: str) -> Node:
    """The tree of one Newick string."""
    root = here = Node()
    above: list[Node] = []
    for m in TOKEN.finditer(text):
        mark, length, comment, name = m.groups()
        if mark == "(":
            above.append(here)
            here.children.append(here := Node())
        elif mark == ",":
            above[-1].children.append(here := Node())
        elif mark == ")":
            here = above.pop()
        elif mark == ";":
            break
        elif length is not None:
            here.length = float(length)
        elif comment is not None:
            here.tags |= dict(x.split("=", 1) for x in comment.split(":") if "=" in x)
        else:
            here.name = name.strip()
    if above:
        raise ValueError("a bracket is not closed")
    return root


def number_unnamed(root: Node, first: int = 0) -> int:
    """Names NAME_n for nodes without one, or with one that came before; returns the next n."""
    seen: set[str] = set()
    for node, _ in root.walk():
        if not node.name or node.name in seen:
            node.name, first = f"NAME_{first}", first + 1
        seen.add(node.name)
    return first


def parse_table(text: str) -> Node:
    """The indented format, `name|alias<TAB>age`, a tab more for each level; nodes with one child give way to it."""
    stack: list[tuple[int, Node, float]] = []
    root = None
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip("\t"))
        names, *rest = line.strip().split("\t")
        name, *aliases = names.split("|")
        node, age = Node(name, tags={"alias": "|".join(aliases)} if aliases else {}), float(rest[0]) if rest else 0.0
        while stack and stack[-1][0] >= depth:
            stack.pop()
        if stack:
            node.length = stack[-1][2] - age
            stack[-1][1].children.append(node)
        else:
            root = node
        stack.append((depth, node, age))
    return collapse(root or Node())


def collapse(root: Node) -> Node:
    """Without nodes of one child; lengths add up."""
    order = [n for n, _ in root.walk()]
    for node in reversed(order):
        for i, c in enumerate(node.children):
            while len(c.children) == 1:
                only = c.children[0]
                only.length += c.length
                c = only
            node.children[i] = c
    while len(root.children) == 1:
        root = root.children[0]
    return root


def write(root: Node, tags: bool = True) -> str:
    """Newick text."""
    out: dict[int, str] = {}
    for node, _ in reversed(list(root.walk())):
        inner = "(" + ",".join(out[id(c)] for c in node.children) + ")" if node.children else ""
        comment = "[&&NHX:" + ":".join(f"{k}={v}" for k, v in sorted(node.tags.items())) + "]" if tags and node.tags else ""
        out[id(node)] = f"{inner}{node.name}:{node.length:g}{comment}"
    return out[id(root)] + ";"


def write_table(root: Node) -> str:
    """The indented format, with ages."""
    ages: dict[int, float] = {}
    for node, _ in reversed(list(root.walk())):
        ages[id(node)] = max((c.length + ages[id(c)] for c in node.children), default=0.0)
    out, depth = [], {id(root): 0}
    for node, parent in root.walk():
        if parent:
            depth[id(node)] = depth[id(parent)] + 1
        out.append("\t" * depth[id(node)] + f"{node.name}\t{ages[id(node)]:g}")
    return "\n".join(out)
