"""Cell, node and material fields between two meshes by one object: each kind's weights are planned once, then any number of
its fields ride in one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import axes
from ..operators import gradient, materials
from .remap import STAGED, Options, Remapper
from .storage import materialize

#: (mesh, fractions, adjacency) -> pieces (id, mat, and ring or points and facets): how material interfaces are found.
Reconstructor = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Side:
    """One mesh: cells, the cells around its nodes, and their neighbours (id, nbr); what is not needed may be missing."""

    cells: DataFrame
    near: DataFrame | None = None
    nodes: DataFrame | None = None
    node_near: DataFrame | None = None


class MultiRemapper:
    """Mesh and material fields from one side to another.

    ``material`` has a row (id, mat, volfrac, fields..) for each material of a cell: sparse, so that a material is a key in
    every join and never a loop.  Its shapes are ``pieces`` (id, mat, and ring or points and facets), or follow from the fractions by
    ``reconstructor``; a material's value stands at the centroid of its pieces, and its slopes are taken over the
    neighbours that hold it too.  The materials of the target follow from the overlaps alone.
    """

    def __init__(self, source: Side, target: Side, dim: int = 2, *, material: DataFrame | None = None, pieces: DataFrame | None = None, reconstructor: Reconstructor | None = None, options: Options = STAGED):
        self.source, self.target, self.dim, self.options = source, target, dim, options
        self.material, self._given = material, pieces
        self.reconstructor = reconstructor or (materials.reconstruct_solids if dim == 3 else materials.reconstruct)
        self._kinds: dict[str, Remapper] = {}
        self._pieces = self._material_weights = None

    def remapper(self, kind: str) -> Remapper:
        """The remapper of cell or node fields."""
        if kind not in self._kinds:
            s, t = self.source, self.target
            if kind == "cell":
                made = Remapper(s.cells, t.cells, self.dim, source_adjacency=s.near, target_adjacency=t.near, options=self.options)
            elif kind == "node":
                if s.nodes is None or t.nodes is None:
                    raise ValueError("node fields need the cells around the nodes of both sides")
                made = Remapper(s.nodes, t.nodes, self.dim, source_adjacency=s.node_near, target_adjacency=t.node_near, ref="p", options=self.options)
            else:
                raise ValueError(f"{kind} is neither cell nor node")
            self._kinds[kind] = made
        return self._kinds[kind]

    def pieces(self) -> DataFrame:
        """The material pieces, written once."""
        if self.material is None:
            raise ValueError("no materials were given")
        if self._pieces is None:
            found = self._given if self._given is not None else self.reconstructor(self.source.cells, self.material.select("id", "mat", "volfrac"), self.source.near)
            self._pieces = materialize(found)
        return self._pieces

    def material_weights(self) -> DataFrame:
        """(tgt_id, src_id, mat, moments), written once."""
        if self._material_weights is None:
            self._material_weights = materialize(materials.material_weights(self.target.cells, self.pieces(), self.dim))
        return self._material_weights

    def target_materials(self) -> DataFrame:
        """(id, mat, volfrac, centroid): the materials that the overlaps bring to each target cell."""
        return materials.material_cells(self.material_weights(), self.target.cells, self.dim, self.options.tolerances.min_absolute_volume)

    def material_slopes(self, fields: Sequence[str], options: Options) -> tuple[DataFrame, DataFrame]:
        """Values at the centroids of their pieces, and their limited slopes."""
        cells, vertices = self.source.cells, "points" if self.dim == 3 else "ring"
        shape = [vertices] if vertices in cells.columns else [a + e for a in axes(self.dim) for e in ("lo", "hi")]
        edge = ["is_boundary"] if "is_boundary" in cells.columns else []
        held = materialize(self.material.select("id", "mat", *fields).join(materials.piece_centroids(self.pieces()).drop("volume"), ["id", "mat"]).join(cells.select("id", *shape, *edge), "id"))
        return held, gradient.gradients(held, self.source.near, list(fields), self.dim, limiter=options.limiter, boundary_limiter=options.boundary_limiter, material="mat")

    def interpolate(self, *, cell: Sequence[str] = (), node: Sequence[str] = (), material: Sequence[str] = (), options: Options | None = None) -> dict[str, DataFrame]:
        """``cell`` and ``node``: (id, fields); ``material``: (id, mat, volfrac, centroid, fields).  Material fields are not
        repaired."""
        o, out = options or self.options, {}
        for kind, fields in (("cell", cell), ("node", node)):
            if fields:
                out[kind] = self.remapper(kind).interpolate(list(fields), o)
        if material:
            self.pieces()
            if o.order > 2:
                raise ValueError("material fields are remapped at first or second order")
            values, slopes = (self.material, None) if o.order == 1 else self.material_slopes(material, o)
            out["material"] = materials.remap_materials(self.material_weights(), values, self.target.cells, list(material), self.dim, slopes=slopes, min_volume=o.tolerances.min_absolute_volume)
        return out
