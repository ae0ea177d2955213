"""Timed-text analytics on PySpark: cue tables, model responses and quality assessments.

The functions below take and return DataFrames; the records are the rows of one
call and of one mended response.
"""

from __future__ import annotations

from cuemill.operators.cues import batch_plan, batches, quality, quality_summary, reindex, slice_cues
from cuemill.operators.mending import Mended, mend
from cuemill.operators.responses import checked, echo_verdict, merged, summary
from cuemill.operators.tqa import Gates
from cuemill.pipeline import answers, prepare_and_write, repair, run_report, self_check, stage_a, summaries, translate, write_run
from cuemill.provider import Reply, instructions, stub_provider
from cuemill.sources.srt import bilingual, parse_strict, parse_tolerant, read_files, to_srt

__all__ = [
    "Gates", "Mended", "Reply", "answers", "batch_plan", "batches", "bilingual", "checked", "echo_verdict", "instructions", "mend", "merged", "parse_strict", "parse_tolerant", "prepare_and_write", "quality", "quality_summary",
    "read_files", "reindex", "repair", "run_report", "self_check", "slice_cues", "stage_a", "stub_provider", "summaries", "summary", "to_srt", "translate", "write_run",
]
