"""Evaluation runs: a strict suite file, frozen subsets, results cached per task, summaries, and evaluations during a run."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterable
from pathlib import Path

from ..functions.text import EVAL_ALIASES
from ..sources.sinks import sha256_json, write_json

TASK_KEYS = {"type", "dataset", "revision"}
FREEZE_KEYS = {"policy", "suffix", "expected_count", "sha256"}
PAIR_TYPES = ("BitextMining", "STS")


def load_suite(path: str | Path, protocol: str | None = None) -> dict:
    """A suite {protocol, benchmark, tasks: {name: {type, dataset, revision[, subsets]}}[, reference_clean_excludes]}.

    Other keys of a task, a revision that is no full digest, an unknown excluded task, all tasks excluded, or an incomplete
    freeze of subsets are errors that name what is wrong.
    """
    suite = json.loads(Path(path).read_text())
    if protocol is not None and suite.get("protocol") != protocol:
        raise ValueError(f"protocol {suite.get('protocol')!r}")
    if not suite.get("benchmark") or not isinstance(suite["benchmark"], str) or not isinstance(suite.get("tasks"), dict) or not suite["tasks"]:
        raise ValueError("a suite has a benchmark and tasks")
    left_out = suite.get("reference_clean_excludes", [])
    if not isinstance(left_out, list) or set(left_out) - set(suite["tasks"]) or (left_out and set(left_out) >= set(suite["tasks"])):
        raise ValueError(f"excluded tasks {left_out}")
    for name, task in suite["tasks"].items():
        if not TASK_KEYS <= set(task) <= TASK_KEYS | {"subsets"}:
            raise ValueError(f"{name}: keys {sorted(task)}")
        if not re.fullmatch(r"[0-9a-f]{40}", str(task["revision"])):
            raise ValueError(f"{name}: revision {task['revision']!r}")
        freeze = task.get("subsets")
        if freeze is not None and (set(freeze) != FREEZE_KEYS or int(freeze["expected_count"]) < 1 or not re.fullmatch(r"[0-9a-f]{64}", str(freeze["sha256"]))):
            raise ValueError(f"{name}: subsets {freeze}")
    return suite


def check_tasks(suite: dict, resolved: dict[str, dict]) -> None:
    """Every task of the suite, and no other, must resolve to its type, dataset and revision."""
    if set(resolved) != set(suite["tasks"]):
        raise ValueError(f"not registered {sorted(set(resolved) - set(suite['tasks']))}, not resolved {sorted(set(suite['tasks']) - set(resolved))}")
    for name, task in suite["tasks"].items():
        differing = [k for k in sorted(TASK_KEYS) if str(resolved[name].get(k)) != str(task[k])]
        if differing:
            raise ValueError(f"{name}: other {differing}")


def marker_languages(languages: Iterable[str]) -> list[str]:
    """A subset's languages as marker languages."""
    plain = [x.replace("-", "_") for x in languages]
    return [EVAL_ALIASES.get(x, x) for x in plain]


def covered_subsets(subsets: dict[str, list[str]], known: Iterable[str], kind: str) -> list[str]:
    """Names of the subsets (name: languages) whose languages a model knows, in their order; none at all is an error.

    Pairs need one or two languages, all known. Retrieval between two languages needs both; any other task its first only,
    since that is the one marker it is given.
    """
    model = set(known)

    def covered(languages: list[str]) -> bool:
        named = marker_languages(languages)
        if kind in PAIR_TYPES:
            return len(named) in (1, 2) and set(named) <= model
        need = named if kind == "Retrieval" and len(named) == 2 else named[:1]
        return bool(need) and set(need) <= model

    out = [name for name, languages in subsets.items() if covered(languages)]
    if not out:
        raise ValueError("the model knows no subset's languages")
    return out


def frozen_subsets(names: list[str], freeze: dict | None) -> list[str]:
    """Subsets under a task's freeze: those with its suffix, as many and with the digest that it states. Without one, all."""
    if not freeze:
        return list(names)
    kept = sorted(n for n in names if n.endswith(freeze["suffix"]))
    if len(kept) != int(freeze["expected_count"]) or sha256_json(kept) != freeze["sha256"]:
        raise ValueError(f"{len(kept)} subsets, other than were frozen")
    return kept


def wanted_subsets(task: str, available: list[str], every: list[str] | None = None, per_task: dict[str, list[str]] | None = None) -> list[str]:
    """Subsets asked for by name, a task's own list before the one for all; a list that shares nothing is an error."""
    asked = (per_task or {}).get(task, every)
    if not asked:
        return list(available)
    kept = [s for s in available if s in set(asked)]
    if not kept:
        raise ValueError(f"{task}: none of {sorted(asked)}")
    return kept


def finite(value) -> float | None:
    """A score as a number; None for truth values, text, NaN and infinities."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        return None
    return float(value)


def slug(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", name)


def run_suite(suite: dict, evaluate: Callable[[str, list[str]], dict[str, float]], subsets: dict[str, list[str]], folder: str | Path, overwrite: bool = False) -> dict:
    """Scores of every task, of which those found in ``folder`` under the same task and subsets are not made again.

    ``evaluate(task, subsets)`` gives the main score of each subset; scores that are not finite do not count, and a task
    left without any is an error. A task's score is the mean of its subsets, the summary's the mean of the tasks', over all
    and over those not excluded. Each task's file is written once it is done, so a run that breaks off goes on where it was.
    """
    folder = Path(folder)
    scores: dict[str, float] = {}
    for name, about in suite["tasks"].items():
        path, identity = folder / f"{slug(name)}.json", {**{k: about[k] for k in sorted(TASK_KEYS)}, "subsets": subsets[name]}
        kept = json.loads(path.read_text()) if path.exists() and not overwrite else None
        if kept is None or kept["identity"] != identity:
            found = {s: x for s, x in ((s, finite(x)) for s, x in evaluate(name, subsets[name]).items()) if x is not None}
            if not found:
                raise ValueError(f"{name}: no finite score")
            kept = {"task": name, "identity": identity, "scores": found}
            write_json(kept, path)
        scores[name] = math.fsum(kept["scores"].values()) / len(kept["scores"])
    clean = [n for n in scores if n not in suite.get("reference_clean_excludes", [])]
    mean = lambda names: {"tasks": names, "score": math.fsum(scores[n] for n in names) / len(names)}
    summary = {"benchmark": suite["benchmark"], "tasks": scores, "all_tasks": mean(list(scores)), "reference_clean": mean(clean)}
    write_json(summary, folder / "summary.json")
    return summary


class PeriodicEvaluation:
    """Evaluations during a run: at its start and at every ``eval_steps``, each step once, over restarts too.

    Steps must be multiples of those at which the run is saved, since what is evaluated is a saved state.
    """

    def __init__(self, evaluate: Callable[[int], dict[str, float]], folder: str | Path, eval_steps: int, save_steps: int, at_start: bool = True):
        if eval_steps < 1 or save_steps < 1 or eval_steps % save_steps:
            raise ValueError(f"evaluation every {eval_steps} steps, saved every {save_steps}")
        self.evaluate, self.folder, self.eval_steps, self.at_start = evaluate, Path(folder), eval_steps, at_start

    def due(self, step: int) -> bool:
        return (step == 0 and self.at_start) or (step > 0 and step % self.eval_steps == 0)

    def at(self, step: int) -> dict[str, float] | None:
        """Scores of a step: None if it is not due, those made before if there are any."""
        if not self.due(step):
            return None
        path = self.folder / f"step-{step}.json"
        if not path.exists():
            found = {k: x for k, x in ((k, finite(v)) for k, v in self.evaluate(step).items()) if x is not None}
            write_json({"step": step, "scores": found}, path)
        return json.loads(path.read_text())["scores"]


def every_n_steps(n: int) -> Callable[[int], bool]:
    """Whether to log at a step: every ``n``, and each step once however often it is asked for."""
    last = [-1]

    def due(step: int) -> bool:
        if step <= last[0] or step % n:
            return False
        last[0] = step
        return True

    return due
