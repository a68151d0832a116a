"""Sinks: JSONL tables, single JSON documents, registries, archives of two documents."""

from __future__ import annotations

import json
import shutil
import zipfile
from collections.abc import Mapping, Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame


def write_lines(df: DataFrame, path: str) -> None:
    """A folder of JSONL files."""
    df.write.mode("overwrite").json(path)


def write_document(df: DataFrame, path: str, order: str = "ord") -> None:
    """One JSON list in the order of a column, which is left out.  For submissions: rows stream through the driver."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with target.open("w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(df.orderBy(order).drop(order).toJSON().toLocalIterator()):
            out.write(("," if i else "") + "\n  " + json.dumps(json.loads(row), ensure_ascii=False))
        out.write("\n]\n")


def merge_registry(path: str, entries: Mapping[str, Mapping], backup: str | None = None) -> dict:
    """Entries put into a JSON registry, later ones over earlier ones; with ``backup`` a copy named by it and the time is kept beside it."""
    target = Path(path)
    if backup and target.exists():
        shutil.copy2(target, target.with_name(f"{target.name}.{backup}_{datetime.now():%Y%m%d_%H%M%S}"))
    known = json.loads(target.read_text(encoding="utf-8")) if target.exists() else {}
    known.update(entries)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(json.dumps(known, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    return known


def write_submission(captions: str, answers: str, path: str, errors: Sequence[DataFrame] = ()) -> None:
    """A zip with the two documents of a submission; a row in one of ``errors``, as the checks give them, stops it."""
    for table in errors:
        if found := table.limit(1).collect():
            raise ValueError(f"the submission is not valid: {found[0].asDict()}")
    with zipfile.ZipFile(path, "w", compression=zipfile.ZIP_DEFLATED) as out:
        out.write(captions, "caption_submission.json")
        out.write(answers, "vqa_submission.json")
