"""Where a model comes in: prompts go through it in Arrow batches, and what it says becomes rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomset.runtime import measured, shuffle_parts

Generator = Callable[[list[str]], Iterable[str]]

#: What stands in for rewrites in a dry run.
DRY_RUN = ("The company reported stronger results as demand grew abroad.", "Officials confirmed the agreement after long talks on Monday.", "Researchers found new evidence that supports the earlier claim.")


def dry_run(prompts: list[str]) -> list[str]:
    return [DRY_RUN[len(p) % len(DRY_RUN)] for p in prompts]


def generate(jobs: DataFrame, make: Callable[[str], Generator], prompt: str = "prompt", model: str = "model_id", batch: int = 16) -> DataFrame:
    """``jobs`` with ``output_text, generation_status, generation_error``. ``make`` gives the generator of a model,
    once in a task; rows of a model come together. A batch that fails is tried row by row, and a row that fails says
    why: no row is lost."""
    extra = [T.StructField("output_text", T.StringType()), T.StructField("generation_status", T.StringType()), T.StructField("generation_error", T.StringType())]
    schema = T.StructType([*jobs.schema.fields, *extra])
    at_p, at_m = jobs.columns.index(prompt), jobs.columns.index(model)

    def answer(run: Generator, prompts: list[str]) -> list[tuple[str | None, str, str | None]]:
        try:
            out = list(run(prompts))
            if len(out) != len(prompts):
                raise ValueError(f"{len(out)} answers to {len(prompts)} prompts")
            return [(x, "ok", None) for x in out]
        except Exception as e:
            if len(prompts) == 1:
                return [(None, "error", f"{type(e).__name__}: {e}")]
            return [x for p in prompts for x in answer(run, [p])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Generator] = {}
        for whole in batches:
            models, prompts = whole.column(at_m).to_pylist(), whole.column(at_p).to_pylist()
            a = 0
            while a < len(prompts):
                z = a + 1
                while z < len(prompts) and z - a < batch and models[z] == models[a]:
                    z += 1
                if models[a] not in made:
                    made.clear()  # one model in memory at a time
                    made[models[a]] = make(models[a])
                got = answer(made[models[a]], [p or "" for p in prompts[a:z]])
                yield pa.RecordBatch.from_arrays([*whole.slice(a, z - a).columns, *(pa.array([x[i] for x in got], pa.string()) for i in range(3))], names=schema.names)
                a = z

    # the prompts of a model are spread over as many tasks as there are partitions, and come together in each
    spread = F.pmod(F.xxhash64(prompt), F.lit(shuffle_parts(jobs.sparkSession)))
    return jobs.repartition(F.col(model), spread).sortWithinPartitions(model).mapInArrow(run, schema)


def to_attempts(answers: DataFrame, slot: list[str], order: str) -> DataFrame:
    """Answers as numbered attempts of their slots, in the order in which they were asked for; failed ones keep their
    place."""
    return answers.withColumn("attempt_idx", (F.row_number().over(W.partitionBy(*slot).orderBy(order)) - 1).cast("int"))


def until_accepted(jobs: DataFrame, slot: list[str], make: Callable[[str], Generator], ask: Callable[[Column], Column], accept: Column, attempts: int, candidates: int = 1, model: str = "model_id") -> DataFrame:
    """Every slot is asked ``candidates`` times an attempt until an answer is accepted, at most ``attempts`` times.
    ``ask`` gives the prompt by the number of the question (a column, from 0); ``accept`` says of an answer
    (``output_text``) whether it will do, null as no. Gives all questions asked, ``jobs`` with ``attempt_idx,
    candidate_idx, prompt, output_text, generation_status, generation_error, accepted``. Slots that are done are
    not asked again; each attempt is written, so a run that is stopped has lost one attempt at most."""
    out, left = None, jobs
    for n in range(attempts):
        asked = left.withColumn("candidate_idx", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1)))).withColumn("attempt_idx", F.lit(n))
        asked = asked.withColumn("prompt", ask(F.col("attempt_idx") * candidates + F.col("candidate_idx")))
        answers = generate(asked, make, model=model).withColumn("accepted", F.coalesce(accept, F.lit(False)) & (F.col("generation_status") == "ok"))
        answers, seen = measured(answers, "answers", n=F.count(F.lit(1)))
        out = answers if out is None else out.unionByName(answers)
        left = left.join(answers.filter("accepted").select(*slot).distinct(), slot, "left_anti")
        if not seen["n"]:
            break
    return out
