"""Settings as tables: tolerant parsing, layered overrides, hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import BACKEND_LABELS, LATENCY_HINTS

# Field, type and default of the settings record.
DEFAULTS = [
    ("whisper_model", "string", "medium.en"),
    ("hotkey", "string", "ctrl+shift+space"),
    ("formatter_backend", "string", "local"),
    ("local_model_path", "string", "models/cleaner/model.gguf"),
    ("llm_word_threshold", "int", 4),
    ("vad_silence_ms", "int", 400),
    ("language", "string", "en"),
    ("recording_mode", "string", "hold"),
    ("history_max", "int", 50),
    ("models_dir", "string", "models"),
    ("log_dir", "string", "logs"),
    ("training_pairs_path", "string", "training_pairs.jsonl"),
]
SCHEMA = ", ".join(f"{name} {typ}" for name, typ, _ in DEFAULTS)
NAMES = [name for name, _, _ in DEFAULTS]


def parse(json_text: Column) -> Column:
    """Settings struct; unknown keys vanish, an unparsable record is all NULL."""
    return F.from_json(json_text, SCHEMA)


def with_settings(df: DataFrame, json_text: str, keep: list[str]) -> DataFrame:
    """Stored settings with defaults for whatever is absent."""
    return df.select(*keep, parse(F.col(json_text)).alias("_s")).select(*keep, *[
        F.coalesce(F.col(f"_s.{name}"), F.lit(default)).alias(name)
        for name, _, default in DEFAULTS])


def to_text(df: DataFrame, keep: list[str]) -> DataFrame:
    """The record as JSON text, every field present."""
    return df.select(*keep, F.to_json(F.struct(*NAMES)).alias("config"))


def layered(cli: Column, env: Column, stored: Column, default: str) -> Column:
    """CLI over non-empty environment over stored over default; empty text never wins a
    layer that ignores it."""
    blank = F.lit("")
    return F.coalesce(F.nullif(cli, blank), F.nullif(env, blank), stored, F.lit(default))


def overlay(stored: DataFrame, env: DataFrame, cli: DataFrame, key: str) -> DataFrame:
    """Effective hotkey, model and backend per user from three layer tables."""
    merged = (stored.alias("s").join(env.alias("e"), key, "left")
              .join(cli.alias("c"), key, "left"))
    none = F.lit(None).cast("string")
    defaults = {n: v for n, _, v in DEFAULTS}
    return merged.select(
        key,
        layered(none, F.col("e.hotkey"), F.col("s.hotkey"), defaults["hotkey"]).alias("hotkey"),
        *[layered(F.col(f"c.{n}"), F.col(f"e.{n}"), F.col(f"s.{n}"), defaults[n]).alias(n)
          for n in ("whisper_model", "formatter_backend")])


def hint(value: Column, table: dict[str, str]) -> Column:
    """Dimension text with an empty default."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(lookup, value), F.lit(""))


def latency_hint(model: Column) -> Column:
    return hint(model, LATENCY_HINTS)


def backend_label(backend: Column) -> Column:
    return hint(backend, BACKEND_LABELS)
