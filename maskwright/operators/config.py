"""Configuration scopes: templates, modes, term precedence, canonical hashes, and a small JSON store on the driver."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import unicodedata
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .detect import ENTITY_TYPES

SCOPES = {"app": 0, "system": 1, "project": 2, "document": 3}
MODES = ("off", "explicit_only", "explicit_eupii", "all")
#: types the token classifier knows; others have no mode of their own for it
FOUR_MODES = ("PERSON", "LOCATION", "ID_NUMBER", "HEALTH_DATA")


def term_key(term: str) -> str:
    return unicodedata.normalize("NFKC", term).strip().casefold()


def resolve_terms(terms: DataFrame, disabled: DataFrame) -> DataFrame:
    """terms(scope, kind, term, term_key, entity_type, role), disabled(scope, kind, term_key) -> the effective terms with their scope and conflict flag.

    A more specific scope wins; within a scope a glossary term beats an ignore term, and the conflict is recorded. A project
    disables entries of the system scope only, a document those of any scope before it; disabling comes before a scope's own terms.
    """
    rank = F.create_map(*(F.lit(x) for pair in SCOPES.items() for x in pair))
    t = terms.withColumn("rank", rank[F.col("scope")])
    off = disabled.select(F.col("kind").alias("dk"), F.col("term_key").alias("dt"), F.col("scope").alias("ds"))
    hit = (t["kind"] == off["dk"]) & (t["term_key"] == off["dt"]) & (((off["ds"] == "project") & (t["scope"] == "system")) | ((off["ds"] == "document") & (t["rank"] < SCOPES["document"])))
    kept = t.join(off, hit, "left_anti")
    both = Window.partitionBy("scope", "term_key")
    marked = kept.withColumn("conflict", F.size(F.collect_set("kind").over(both)) > 1)
    best = Window.partitionBy("term_key").orderBy(F.desc("rank"), F.when(F.col("kind") == "glossary", 0).otherwise(1))
    return marked.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "rank")


def resolve_modes(types: DataFrame, project: DataFrame, document: DataFrame) -> DataFrame:
    """types(entity_type) with the mode of the document, else of the project, else all."""
    p, d = project.withColumnRenamed("mode", "pm"), document.withColumnRenamed("mode", "dm")
    return types.join(p, "entity_type", "left").join(d, "entity_type", "left").select("entity_type", F.coalesce("dm", "pm", F.lit("all")).alias("mode"))


def legacy_modes(types: DataFrame, active: DataFrame) -> DataFrame:
    """Modes from an old list of active types: the classifier's four become explicit_eupii, other active ones all, the rest off."""
    a = active.select("entity_type", F.lit(True).alias("on"))
    return types.join(a, "entity_type", "left").select("entity_type", F.when(F.col("on").isNull(), "off").when(F.col("entity_type").isin(*FOUR_MODES), "explicit_eupii").otherwise("all").alias("mode"))


def mode_choices(types: DataFrame) -> DataFrame:
    return types.select("entity_type", F.when(F.col("entity_type").isin(*FOUR_MODES), F.array(*map(F.lit, MODES))).otherwise(F.array(*map(F.lit, ("off", "explicit_only", "all")))).alias("choices"))


#: fixed values: ids of the built-in templates and the types whose mode isn't "all"
TEMPLATES = {
    "builtin-standard-full": {},
    "builtin-ch-standard": {"explicit_eupii": ("HEALTH_DATA",), "explicit_only": ("CRYPTO", "IP_ADDRESS", "MAC_ADDRESS", "ROLE"), "off": ("IT_SYSTEM",)},
    "builtin-medical": {"explicit_only": ("BANK_ACCOUNT", "FINANCIAL_DATA", "IBAN_CODE", "ROLE", "UID_NUMBER"), "off": ("CREDIT_CARD", "CRYPTO", "IP_ADDRESS", "IT_SYSTEM", "MAC_ADDRESS", "URL", "USERNAME")},
    "builtin-business-finance": {"explicit_only": ("IP_ADDRESS", "IT_SYSTEM", "MAC_ADDRESS", "ROLE"), "off": ("HEALTH_DATA", "MEDICAL_LICENSE")},
    "builtin-minimal-ids": {"explicit_only": ("ADDRESS",), "off": ("CRYPTO", "DATE_TIME", "FINANCIAL_DATA", "HEALTH_DATA", "IP_ADDRESS", "IT_SYSTEM", "LOCATION", "MAC_ADDRESS", "MEDICAL_LICENSE", "ORGANIZATION", "ROLE", "URL")},
}


def templates(spark: SparkSession) -> DataFrame:
    """(template_id, entity_type, mode) of the built-in templates."""
    rows = [(t, e, next((m for m, types in changed.items() if e in types), "all")) for t, changed in TEMPLATES.items() for e in ENTITY_TYPES]
    return spark.createDataFrame(rows, "template_id string, entity_type string, mode string")


def snapshot_hash(content: dict) -> str:
    """SHA-256 of the canonical JSON form: sorted keys, no spaces, no ASCII escapes."""
    return hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def source_overview(registry: DataFrame) -> DataFrame:
    """registry(entity_type, source, item, active) -> per type: prompts, number of glossary terms, sources, whether any is active."""
    items = lambda s: F.array_sort(F.collect_set(F.when(F.col("source") == s, F.col("item"))))
    return registry.groupBy("entity_type").agg(items("prompt").alias("prompts"), F.count_if(F.col("source") == "glossary").alias("n_glossary"), F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or("active").alias("active"))


def engine_arguments(modes: dict[str, str]) -> dict[str, list[str]]:
    """Engine type lists of a set of modes: what general detectors may find, and what the glossary may."""
    return {"entity_types": sorted(e for e in ENTITY_TYPES if modes.get(e, "all") in ("all", "explicit_eupii")), "glossary_types": sorted(e for e in ENTITY_TYPES if modes.get(e, "all") != "off")}


def application_settings(raw: dict, default_model: str = "") -> dict:
    """Flat settings read back: cloud models give way to the default, modes that don't exist are dropped."""
    model = str(raw.get("model", default_model))
    return {**raw, "model": default_model if ":cloud" in model.lower() else model, "modes": {e: m for e, m in raw.get("modes", {}).items() if e in ENTITY_TYPES and m in MODES}}


class RevisionConflict(RuntimeError):
    """The stored revision is not the one that was read."""


@dataclass(frozen=True)
class Project:
    name: str
    project_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    revision: int = 0
    modes: dict[str, str] = field(default_factory=dict)
    glossary: dict[str, str] = field(default_factory=dict)
    ignore: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.name.strip() or any(ord(c) < 32 for c in self.name) or len(self.name) > 200:
            raise ValueError("a project's name has 1 to 200 printable characters")
        if isinstance(self.revision, bool) or not isinstance(self.revision, int) or self.revision < 0:
            raise ValueError("a revision is a number from 0")
        if bad := {m for m in self.modes.values()} - set(MODES):
            raise ValueError(f"unknown modes {sorted(bad)}")


class ProjectStore:
    """Projects as JSON files: closed field sets, atomic writes, compare-and-swap on the revision, unique folded names."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)

    def list(self) -> list[Project]:
        found = [self._read(p) for p in self.folder.glob("*.json")]
        return sorted(found, key=lambda p: (p.name != "default", term_key(p.name)))

    def load(self, project_id: str) -> Project:
        return self._read(self.folder / f"{project_id}.json")

    def save(self, project: Project) -> Project:
        path = self.folder / f"{project.project_id}.json"
        if (path.exists() and self._read(path).revision != project.revision) or (not path.exists() and project.revision):
            raise RevisionConflict(project.name)
        if any(term_key(p.name) == term_key(project.name) and p.project_id != project.project_id for p in self.list()):
            raise ValueError(f"there is a project named {project.name}")
        new = Project(project.name, project.project_id, project.revision + 1, project.modes, project.glossary, project.ignore)
        with tempfile.NamedTemporaryFile("w", dir=self.folder, suffix=".tmp", delete=False, encoding="utf-8") as f:
            json.dump({**new.__dict__, "ignore": list(new.ignore)}, f, ensure_ascii=False, indent=2)
        os.replace(f.name, path)
        return new

    def delete(self, project_id: str) -> None:
        every = self.list()
        if self.load(project_id).name == "default" or len(every) == 1:
            raise ValueError("the default project and the last one stay")
        (self.folder / f"{project_id}.json").unlink()

    def apply_template(self, project: Project, template_id: str) -> Project:
        """A snapshot of the template's modes replaces the project's."""
        changed = TEMPLATES[template_id]
        return Project(project.name, project.project_id, project.revision, {e: next((m for m, types in changed.items() if e in types), "all") for e in ENTITY_TYPES}, project.glossary, project.ignore)

    @staticmethod
    def _read(path: Path) -> Project:
        raw = json.loads(path.read_text(encoding="utf-8"))
        if set(raw) != {"name", "project_id", "revision", "modes", "glossary", "ignore"}:
            raise ValueError(f"unknown or missing fields in {path.name}")
        return Project(**{**raw, "ignore": tuple(raw["ignore"])})


class UnsavedChanges(RuntimeError):
    """A document's own terms would be lost."""


class Session:
    """A project in use with the terms of one document, which last as long as the document; system terms change on confirmation only."""

    def __init__(self, store: ProjectStore, project_id: str):
        self.store, self.project, self.overlay, self.system = store, store.load(project_id), {}, {}

    def mark(self, term: str, entity_type: str) -> None:
        self.overlay[term_key(term)] = entity_type

    def mark_system(self, term: str, entity_type: str, confirmed: bool = False) -> None:
        if not confirmed:
            raise PermissionError("a system term needs a confirmation")
        self.system[term_key(term)] = entity_type

    def switch(self, project_id: str, discard: bool = False) -> Project:
        if self.overlay and not discard:
            raise UnsavedChanges(self.project.name)
        self.project, self.overlay = self.store.load(project_id), {}
        return self.project

    def glossary(self) -> dict[str, str]:
        """Effective terms: the document's over the project's over the system's."""
        return {**self.system, **{term_key(t): e for t, e in self.project.glossary.items()}, **self.overlay}


STEPS = ("backup", "project", "done")


def migrate(old: Path, store: ProjectStore) -> Project:
    """A flat configuration file becomes the project `default`, in steps kept in a journal so that it may be broken off anywhere.

    The project's id is chosen once; a source that changes in between is refused; the source is renamed at the end.
    """
    journal_file, raw = store.folder / "migration.journal", None
    journal = json.loads(journal_file.read_text()) if journal_file.exists() else {"project_id": str(uuid.uuid4()), "step": ""}
    backup = store.folder / "migration.backup"
    raw = old.read_bytes() if old.exists() else backup.read_bytes()
    digest = hashlib.sha256(raw).hexdigest()
    if journal.setdefault("source", digest) != digest:
        raise ValueError("the configuration changed while it was being migrated")

    def reached(step: str) -> None:
        journal["step"] = step
        journal_file.write_text(json.dumps(journal))

    if journal["step"] not in STEPS:
        backup.write_bytes(raw)
        reached("backup")
    if journal["step"] == "backup":
        settings = json.loads(raw)
        active = set(settings.get("entities", ENTITY_TYPES))
        modes = {e: "off" if e not in active else "explicit_eupii" if e in FOUR_MODES else "all" for e in ENTITY_TYPES}
        if not (store.folder / f"{journal['project_id']}.json").exists():
            store.save(Project("default", journal["project_id"], 0, modes, dict(settings.get("glossary", {})), tuple(settings.get("ignore_terms", ()))))
        reached("project")
    if journal["step"] == "project":
        if old.exists():
            old.rename(old.with_suffix(".migrated.json"))
        reached("done")
    return store.load(journal["project_id"])
