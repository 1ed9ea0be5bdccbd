"""Generated texts: pending queue, prompts, batch generation, run summary.

Generation is the one place Python runs on rows: the caller's batch function
(list of prompts -> list of texts) is called through `mapInArrow`, made once
per partition, on Arrow batches that hold only the key and the two prompts
(a filter above `mapInArrow` is not pushed below it, so the plan filters and
projects first).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow import schema
from postflow.functions.prompts import cold_email_prompt, cover_letter_prompt

BatchFn = Callable[[Sequence[str]], Sequence[str]]
GeneratorFactory = Callable[[], BatchFn]


# ---------------------------------------------------------------------------
# generators (named batch functions)
# ---------------------------------------------------------------------------

class GenerationError(RuntimeError):
    pass


_GENERATORS: dict[str, GeneratorFactory] = {}


def register_generator(name: str, factory: GeneratorFactory) -> None:
    """Add a named backend; `factory()` is called once per partition."""
    _GENERATORS[name] = factory


def generator_for(name: str) -> GeneratorFactory:
    if name not in _GENERATORS:
        raise ValueError(f"Unsupported generator backend: {name!r}. Known: {sorted(_GENERATORS)}")
    return _GENERATORS[name]


# ---------------------------------------------------------------------------
# queue and prompts
# ---------------------------------------------------------------------------

def succeeded() -> Column:
    """A materials row that takes its posting off the queue: made without an error
    (an empty text counts, no text does not). The one rule for table, view and stream."""
    return F.col("error").isNull() & F.col("cover_letter").isNotNull()


def pending(view: DataFrame) -> DataFrame:
    """Postings without a cover letter yet (NULL only: an empty text is not pending)."""
    return view.filter(F.col("generated_cover_letter").isNull())


def pending_from(postings: DataFrame, materials: DataFrame) -> DataFrame:
    """Pending postings straight from the tables: no successful materials row."""
    return postings.join(materials.filter(succeeded()).select("job_board_id"), "job_board_id", "left_anti")


def prompts(rows: DataFrame, resume_summary: str) -> DataFrame:
    """job_board_id plus both prompts, every hole filled once."""
    rs = F.lit(resume_summary)
    return rows.select(
        "job_board_id",
        cover_letter_prompt(rs).alias("cover_prompt"),
        cold_email_prompt(rs).alias("email_prompt"),
    )


# ---------------------------------------------------------------------------
# generation
# ---------------------------------------------------------------------------

def _call(fn: BatchFn, items: list[str]) -> tuple[list[str | None], list[str | None]]:
    """Texts and errors of a chunk. A chunk that fails is halved until the failing
    prompt stands alone, so texts that were made are kept and one bad prompt costs
    a logarithm of the chunk in further calls. No text (None) is an error."""
    try:
        out = list(fn(items))
        if len(out) != len(items):
            raise GenerationError(f"generator returned {len(out)} texts for {len(items)} prompts")
    except Exception as exc:  # noqa: BLE001 - the error goes to the row
        if len(items) == 1:
            return [None], [type(exc).__name__]
        half = len(items) // 2
        (t1, e1), (t2, e2) = _call(fn, items[:half]), _call(fn, items[half:])
        return t1 + t2, e1 + e2
    return ([None if t is None else str(t) for t in out],
            [GenerationError.__name__ if t is None else None for t in out])


def generate(prompt_rows: DataFrame, generator: str | GeneratorFactory, as_of: dt.datetime,
             name: str | None = None, call_size: int = 64) -> DataFrame:
    """Materials rows (job_board_id, cover_letter, cold_email, generator, generated_at, error).

    A row whose either call fails gets `error` set and both texts null, so it
    stays pending; other rows of the batch are unaffected. The generator gets
    at most `call_size` prompts per call (prompts carry whole descriptions), and
    only those of one call are Python strings at a time: the rest of an Arrow batch,
    which Spark caps in rows and bytes (`spark.sql.execution.arrow.maxRecordsPerBatch`,
    `maxBytesPerBatch`), stays in Arrow's own buffer.
    """
    factory = generator_for(generator) if isinstance(generator, str) else generator
    gen_name = name or (generator if isinstance(generator, str) else getattr(factory, "__name__", "custom"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, call_size):
                keys, covers, emails = batch.slice(start, call_size).columns
                covers, cerr = _call(fn, [p or "" for p in covers.to_pylist()])
                emails, eerr = _call(fn, [p or "" for p in emails.to_pylist()])
                err = [c or e for c, e in zip(cerr, eerr)]
                yield pa.RecordBatch.from_pydict({
                    "job_board_id": keys,
                    "cover_letter": pa.array([None if x else c for c, x in zip(covers, err)], pa.string()),
                    "cold_email": pa.array([None if x else m for m, x in zip(emails, err)], pa.string()),
                    "generator": pa.array([gen_name] * len(err), pa.string()),
                    "generated_at": pa.array([as_of] * len(err), pa.timestamp("us")),
                    "error": pa.array(err, pa.string()),
                })

    return prompt_rows.select("job_board_id", "cover_prompt", "email_prompt").mapInArrow(run, schema.MATERIALS)


def run_generation(view: DataFrame, resume_summary: str, generator: str | GeneratorFactory,
                   as_of: dt.datetime, limit: int = 0) -> DataFrame:
    """Pending -> prompts -> generate. `limit` N > 0 takes the N lowest ids (a bounded run)."""
    todo = pending(view)
    if limit:
        # the N ids are picked on the id alone; descriptions stay where they are
        todo = todo.join(todo.select("id").orderBy("id").limit(limit), "id", "left_semi")
    return generate(prompts(todo, resume_summary), generator, as_of)


def run_summary(view: DataFrame, produced: DataFrame) -> DataFrame:
    """generated / empty / failed counts of a run, and how many postings of `view` are
    pending once its texts are in (whether or not the view has them already)."""
    text = F.coalesce(F.col("cover_letter"), F.lit(""))
    ran = produced.select(
        F.lit(True).alias("_run"),
        (succeeded() & (text != "")).alias("_gen"),
        (succeeded() & (text == "")).alias("_empty"),
        (~succeeded()).alias("_fail"))
    left = pending_from(pending(view), produced).select(
        F.lit(False).alias("_run"), F.lit(False).alias("_gen"), F.lit(False).alias("_empty"),
        F.lit(False).alias("_fail"))
    return ran.unionByName(left).agg(
        F.count_if("_gen").alias("generated"),
        F.count_if("_empty").alias("empty"),
        F.count_if("_fail").alias("failed"),
        F.count_if(~F.col("_run")).alias("remaining"),
    )
