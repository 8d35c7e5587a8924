"""Declarative remap jobs: a dataclass from JSON, and the plan it stands for."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tolerances import EMPTY_FIXUPS, PARTIAL_FIXUPS, one_of
from ..operators import repair
from ..plans.remap import Options, Remapper
from .meshes import translate, with_field


@dataclass
class PartPair:
    uid: int
    source: str
    target: str


@dataclass
class Job:
    dimension: int
    source: str
    target: str
    options: Options
    fields: dict[str, str]
    parts: dict[str, list[PartPair]] = field(default_factory=dict)


def parse(text: str) -> Job:
    raw = json.loads(text)
    r, fix = raw["remap"], raw["remap"].get("fixup", {})
    options = Options(
        order=int(r.get("order", 1)), limiter="barth_jespersen" if r.get("limiter") else "nolimiter", boundary_limiter="bnd_barth_jespersen" if r.get("bnd_limiter") else "bnd_nolimiter",
        partial=one_of(fix.get("partial", "globally_conservative"), PARTIAL_FIXUPS), empty=one_of(fix.get("empty", "extrapolate"), EMPTY_FIXUPS), max_iterations=int(fix.get("max-iter", 5)),
    )
    parts = {p["field"]: [PartPair(int(x["uid"]), x["source"], x["target"]) for x in p["pairs"]] for p in raw.get("parts", [])}
    return Job(int(raw["mesh"]["dimension"]), raw["mesh"]["source"], raw["mesh"]["target"], options, {f["name"]: f["expr"] for f in r["fields"]}, parts)


def _predicate(expression: str) -> str:
    import re

    return re.sub(r"\b([xyz])\b", r"c\1", translate(expression))


def run(job: Job, load: Callable[[str], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """id and every field on the target; fields with parts are remapped and repaired part by part.

    ``load`` gives (cells, adjacency) of a mesh by its name in the job.
    """
    (source, s_near), (target, t_near) = load(job.source), load(job.target)
    out = target.select("id")
    for name, formula in job.fields.items():
        held = with_field(source, name, formula, job.dimension)
        if name not in job.parts:
            got = Remapper(held, target, job.dimension, source_adjacency=s_near, target_adjacency=t_near, options=job.options).interpolate([name])
        else:
            tag = lambda df, side, n=name: df.withColumn("part", F.coalesce(*[F.when(F.expr(_predicate(getattr(p, side))), F.lit(p.uid)) for p in job.parts[n]]))
            s, t = tag(held, "source").where("part is not null"), tag(target, "target").where("part is not null")
            plain = Options(order=job.options.order, limiter=job.options.limiter, boundary_limiter=job.options.boundary_limiter, check_mismatch=False)
            mapper = Remapper(s, t, job.dimension, source_adjacency=s_near, target_adjacency=t_near, part="part", options=plain)
            values, weights = mapper.interpolate([name]), mapper.weights()
            each = [
                (values.join(t.where(F.col("part") == p.uid).select("id"), "id"), t.where(F.col("part") == p.uid), s.where(F.col("part") == p.uid), weights.where(F.col("part") == p.uid)) for p in job.parts[name]
            ]
            got = repair.part_repair(each, name, t_near, partial=job.options.partial, empty=job.options.empty, max_iterations=job.options.max_iterations)
        out = out.join(got, "id", "left").fillna(0.0, subset=[name])
    return out
