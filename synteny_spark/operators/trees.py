"""The species tree: closure, paths and target languages on the driver, and their tables.

A species tree has at most some thousands of nodes; it is a driver object, and its tables are small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synteny_spark.operators.spread import checkpointed
from synteny_spark.sources.newick import Node, collapse, number_unnamed, parse, parse_table


class SpeciesTree:
    def __init__(self, root: Node):
        number_unnamed(root)
        self.root = root.name
        self.children: dict[str, list[str]] = {}
        self.parent: dict[str, str] = {}
        self.length: dict[str, float] = {root.name: 0.0}
        self.coverage: dict[str, str] = {}
        self.alias: dict[str, str] = {}
        order = []
        for node, parent in root.walk():
            kind = {".": "6X", "*": "2X"}.get(node.name[:1])
            name = node.name[1:] if kind else node.name
            self.coverage[name] = kind or "full"
            node.name = name
            for a in filter(None, node.tags.get("alias", "").split("|")):
                self.alias[a] = name
            order.append(name)
            self.children[name] = []
            if parent:
                self.parent[name] = parent.name
                self.children[parent.name].append(name)
                self.length[name] = node.length
        self.ancestors = [n for n in order if self.children[n]]
        self.species = [n for n in order if not self.children[n]]
        self.ord = {n: i for i, n in enumerate(self.ancestors + self.species)}
        self.below: dict[str, list[str]] = {}
        self.leaves: dict[str, set[str]] = {}
        self.age: dict[str, float] = {}
        for n in reversed(order):
            kids = self.children[n]
            self.below[n] = [n, *(d for c in kids for d in self.below[c])]
            self.leaves[n] = {d for c in kids for d in self.leaves[c]} or {n}
            self.age[n] = max((self.length[c] + self.age[c] for c in kids), default=0.0)
        self.outgroup = {n: set(self.species) - self.leaves[n] for n in order}

    @classmethod
    def read(cls, text: str) -> "SpeciesTree":
        """Newick if the text has a bracket or a semicolon in its first line, else the indented format."""
        first = next((x for x in text.splitlines() if x.strip() and not x.startswith("#")), "")
        return cls(collapse(parse(text)) if set(first) & set(";(") else parse_table(text))

    def official(self, name: str) -> str:
        return self.alias.get(name, name)

    def up(self, node: str) -> list[str]:
        """The node and all above it."""
        out = [node]
        while out[-1] in self.parent:
            out.append(self.parent[out[-1]])
        return out

    def species_since(self, ancestor: str) -> list[str]:
        """The species below an ancestor; all of them for a name that is none."""
        return sorted(self.leaves.get(self.official(ancestor), self.species))

    def species_before(self, ancestor: str) -> list[str]:
        """The species that aren't below an ancestor; all of them for a name that is none."""
        return sorted(self.outgroup.get(self.official(ancestor), self.species))

    def lca(self, *nodes: str) -> str:
        found = self.official(nodes[0])
        for n in nodes[1:]:
            above = set(self.up(self.official(n)))
            found = next(a for a in self.up(found) if a in above)
        return found

    def is_below(self, child: str, parent: str) -> bool:
        return self.lca(child, parent) == self.official(parent)

    def path(self, a: str, b: str) -> list[str]:
        top = self.lca(a, b)
        rise, fall = self.up(a), self.up(b)
        return rise[: rise.index(top) + 1] + fall[: fall.index(top)][::-1]

    @staticmethod
    def _terms(target: str, of) -> set[str]:
        out: set[str] = set()
        for term in target.split(","):
            remove = term.startswith("_")
            term = term[remove:]
            chosen = {term[1:]} if term.startswith("=") else of(term)
            out = out - chosen if remove else out | chosen
        return out

    def species_targets(self, target: str) -> set[str]:
        """X: the leaves below; =X: itself; /X: those outside; _ before a term takes away; from left to right."""
        return self._terms(target, lambda t: self.outgroup[self.official(t[1:])] if t.startswith("/") else self.leaves[self.official(t)])

    def ancestor_targets(self, target: str) -> set[str]:
        """X: itself and the ancestors below; =X: itself; \\X: itself and those above; /X: all that aren't X or below; _ takes away."""

        def of(t: str) -> set[str]:
            if t.startswith("/"):
                return {a for a in self.ancestors if not self.is_below(a, t[1:])}
            if t.startswith("\\"):
                return {a for a in self.ancestors if self.is_below(t[1:], a)}
            return {a for a in self.ancestors if self.is_below(a, t)}

        return self._terms(target, of)

    def pairwise_targets(self, target: str, species_filter: str = "") -> tuple[set[str], set[str], set[str]]:
        """Species, ancestors strictly between two of them among the targets, and common ancestors needed besides."""
        wanted = self.ancestor_targets(target)
        species = {s for n in self.species_targets(species_filter) for s in self.leaves[n]} if species_filter else set(self.species)
        ancestors, needed = set(), set()
        for a, b in combinations(sorted(species), 2):
            if between := wanted.intersection(self.path(a, b)[1:-1]):
                ancestors |= between
                needed.add(self.lca(a, b))
        if not ancestors:
            raise ValueError(f"no target ancestors: target={target} species={species_filter}")
        return species, ancestors, needed - ancestors

    def genome_targets(self, target: str) -> tuple[set[str], set[str]]:
        """The older language: .X is a genome itself; a + at the end takes all nodes between two species, not their common one."""
        all_between = target.endswith("+")
        species, ancestors = set(), set()
        for x in target.rstrip("+").split(","):
            if x.startswith("."):
                species.add(x[1:])
                ancestors.add(x[1:])
            else:
                species |= self.leaves[self.official(x)]
        for a, b in combinations(sorted(species), 2):
            ancestors |= set(self.path(a, b)[1:-1]) if all_between else {self.lca(a, b)}
        return species, ancestors

    def subtree(self, species: Iterable[str], root: str | None = None) -> tuple[str, dict[str, list[str]]]:
        """Root and children of the tree that these species alone span."""
        good = set(species)
        forks = {self.lca(a, b) for a, b in combinations(sorted(good), 2)}
        tops: dict[str, list[str]] = {}
        new: dict[str, list[str]] = {}
        for n in reversed(self.below[root or self.root]):
            found = [t for c in self.children[n] for t in tops[c]]
            if n in forks:
                new[n] = found
                found = [n]
            tops[n] = [n] if not self.children[n] and n in good else found
        (top,) = tops[root or self.root]
        return top, new

    def compact(self, least: float = 1e-4) -> "SpeciesTree":
        """Without inner nodes on branches shorter than least; their children go to the parent."""

        def build(name: str) -> Node:
            node = Node(name, self.length[name])
            for c in self.children[name]:
                made = build(c)
                node.children += [made] if self.length[c] >= least or not made.children else made.children
            return node

        return SpeciesTree(build(self.root))

    def reroot(self, node: str, outgroups: bool = True, name: str = "0") -> dict[str, list[tuple[str, float]]]:
        """Children (and lengths) of each node as seen from this one, under a new root."""
        items = {n: [(c, self.length[c]) for c in kids] for n, kids in self.children.items() if kids}
        if outgroups:
            for child in self.up(node)[:-1]:
                par = self.parent[child]
                items[child] = items.get(child, []) + [(par, self.length[child])]
                items[par] = [x for x in items[par] if x[0] != child]
        items[name] = items[node]
        return items

    def file_name(self, node: str) -> str:
        return node.replace(" ", ".") if not self.children[node] else node

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = [(n, self.parent.get(n), self.length[n], self.children[self.parent[n]].index(n) if n in self.parent else 0, not self.children[n], self.age[n], self.coverage[n], self.ord[n]) for n in self.ord]
        return spark.createDataFrame(rows, "node string, parent string, branch_len double, child_ord int, is_leaf boolean, age double, coverage string, ord int")

    def closure(self, spark: SparkSession) -> DataFrame:
        """anc, desc, via (the child of anc on the way; null for anc itself) and depth."""
        rows = [(a, n, up[k - 1] if k else None, k) for n in self.ord for up in [self.up(n)] for k, a in enumerate(up)]
        return spark.createDataFrame(rows, "anc string, desc string, via string, depth int")

    def groups(self, spark: SparkSession) -> DataFrame:
        """anc, species and grp: the number from 1 of the child that the species is below, -1 outside."""
        rows = [(a, s, next((i + 1 for i, c in enumerate(self.children[a]) if s in self.leaves[c]), -1)) for a in self.ancestors for s in self.species]
        return spark.createDataFrame(rows, "anc string, species string, grp int")


def closure_of(edges: DataFrame) -> DataFrame:
    """anc, desc, depth of any table of edges (parent, node) that form trees, of any size: each round doubles the reach of the steps
    up, and so of what is known, so there are as many rounds as the logarithm of the depth."""
    far = 1
    up = checkpointed(edges.where("parent is not null").select("node", F.col("parent").alias("to")))
    known = checkpointed(edges.select(F.col("node").alias("anc"), F.col("node").alias("desc"), F.lit(0).alias("depth")))
    while not up.isEmpty():
        more = known.join(up, F.col("anc") == F.col("node")).select(F.col("to").alias("anc"), "desc", (F.col("depth") + far).alias("depth"))
        known = checkpointed(known.union(more))
        up = checkpointed(up.select("node", F.col("to").alias("mid")).join(up.select(F.col("node").alias("mid"), "to"), "mid").select("node", "to"))
        far *= 2
    return known


def pair_paths(closure: DataFrame) -> DataFrame:
    """a, b, anc: the ancestors strictly between every two species a < b, their common one among them. closure has its rows of
    species as desc; the tree is small, and so is this."""
    up = closure.where("depth > 0").select("anc", "desc", "depth")
    met = up.alias("x").join(up.alias("y"), "anc").where("x.desc < y.desc")
    top = met.groupBy(F.col("x.desc").alias("a"), F.col("y.desc").alias("b")).agg(F.min("x.depth").alias("da"), F.min("y.depth").alias("db"))
    side = lambda name, most: top.join(up, F.col(name) == F.col("desc")).where(F.col("depth") <= F.col(most)).select("a", "b", "anc")
    return side("a", "da").union(side("b", "db")).distinct()
