"""Raw transcript lines into clean, ordered speaker turns (problem 2)."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.operators.sequences import chunked_runs, with_previous
from cadenza.sources.shared import written

# Labels that name nobody, and hesitations. Those of AMBIGUOUS are words of some language: inside speech of
# that language they go only if punctuation sets them off.
NOBODY = {"", "?", "-", "unknown", "speaker_unknown", "unk", "n/a", "none", "null"}
HESITATIONS = {
    "uh", "uhh", "um", "umm", "uhm", "er", "err", "erm", "ah", "ahh", "aah", "hm", "hmm", "hmmm", "mm", "mmm", "mhm", "mm-hmm", "mm-hm", "uh-huh", "eh", "ehm", "em",
    "éé", "ééé", "hã", "hãã", "ahn", "ãh", "hum", "humm", "euh", "heu", "äh", "ähm", "öh", "öhm", "э", "э-э", "ээ", "э-э-э", "эм", "эмм", "м-м", "мм", "ммм", "м-м-м", "гм", "хм",
}
AMBIGUOUS = {
    "um": {"não", "que", "uma", "para", "com", "é", "mais", "os", "ele", "ela", "eles", "nós", "se", "na", "no"},
    "em": {"não", "que", "uma", "para", "com", "é", "mais", "os", "ele", "ela", "eles", "nós", "se", "na", "no"},
    "er": {"der", "die", "das", "und", "ist", "nicht", "ich", "wir", "mit", "zu"},
    "ah": set(), "eh": set(), "hum": set(),
}

_CLOCK = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_TIME = re.compile(rf"[\[(<{{]\s*({_CLOCK})\s*(?:-->?\s*{_CLOCK}\s*)?[\])>}}]|(?<![\w:])({_CLOCK})\s*-->(?:\s*{_CLOCK})?|(?<![\w:])(\d{{1,3}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?)(?![\w:])")
_BRACKET = re.compile(r"\[([^\[\]]*)\]|\(\(([^()]*)\)\)|\(([^()]*)\)|<([^<>]*)>|\{([^{}]*)\}|\*([^*\n]+)\*|♪([^♪\n]*)♪|[♪♫]+")
_NUMBER = re.compile(r"(?:speaker|spkr|spk|sp|s)[\s_#.\-]*0*(\d{1,4})")
_LABEL = re.compile(r"(?:^|(?<=[\n.?!…>:\-–—\x01]))[\s\x01]*(?:>>+|[-–—])?[ \t]*((?:[^\s:\x01>]+,?[ \t]+)??[^\s:\x01>]+)[ \t]*:(?=\s|$|\x01)")
_TOKEN = re.compile(r"[\w'’]+(?:-[\w'’]+)*")


def clock_ms(mark: str) -> int:
    whole, _, part = mark.replace(",", ".").partition(".")
    seconds = functools.reduce(lambda total, x: total * 60 + int(x), whole.split(":"), 0)
    return seconds * 1000 + int((part + "000")[:3])


def resolve(label: str | None, names: dict[str, str]) -> str | None:
    """Speaker that a label stands for: a number in any spelling, a first or full name of the workspace, 'Last, First'."""
    bare = re.sub(r"^[\s\[({<>\-–—]+|[\s\])}>:]+$", "", label or "").lower()
    bare = re.sub(r"\s+", " ", bare)
    if bare in NOBODY:
        return None
    if m := _NUMBER.fullmatch(bare):
        return f"speaker_{int(m[1]):02d}"
    if bare in names:
        return names[bare]
    last, comma, first = bare.partition(",")
    return names.get(f"{first.strip()} {last.strip()}") if comma else None


def pieces(text: str | None, label: str | None, names: dict[str, str]) -> tuple[int | None, list[tuple[str | None, str]]]:
    """Time stated at the beginning of a line (ms) and its (speaker, clean text) pieces, empty ones left out."""
    text = text or ""
    stated = None
    if (m := _TIME.search(text)) and not _TOKEN.search(text[: m.start()]):
        stated = clock_ms(m[1] or m[2] or m[3])
    text = _TIME.sub(" \x01 ", text)

    def bracket(m: re.Match) -> str:
        inner = next((g for g in m.groups() if g is not None), "")
        who = resolve(inner, names) if m[0][0] in "[(<{" else None
        return f"\n\x02{who}\x02" if who else " \x01 "

    text = _BRACKET.sub(bracket, text)
    out: list[tuple[str | None, str]] = []
    speaker, at = resolve(label, names), 0
    marks = [(m.start(), m.end(), m[1]) for m in re.finditer(r"\x02([^\x02]*)\x02[ \t]*:?", text)]
    for m in _LABEL.finditer(text):
        two = m[1].split()
        for said, start in ((m[1], m.start()), (two[-1], m.end() - len(two[-1]) - 1)):
            if who := resolve(said, names):
                marks.append((start, m.end(), who))
                break
    for start, end, who in sorted(marks):
        if start < at:
            continue
        out.append((speaker, text[at:start]))
        speaker, at = who, end
    out.append((speaker, text[at:]))
    return stated, [(who, clean) for who, raw in out if (clean := spoken(raw))]


def spoken(raw: str) -> str:
    """The words of a piece without hesitations; '' if none is left."""
    raw = re.sub(r"^\s*(?:>>+|[-–—])\s*|\s+(?:>>+|[-–—])\s*$", "", raw.replace("\x01", " ").replace("\n", " "))  # turn marks
    words = {w.lower() for w in _TOKEN.findall(raw)}
    kept = []
    tokens = raw.split()
    for i, tok in enumerate(tokens):
        core = tok.strip(".,;:!?…\"“”«»()").lower()
        if core in HESITATIONS:
            loose = tok.strip("\"“”«»()").lower() != core
            if loose or not (AMBIGUOUS.get(core, set()) & words):
                continue
        if core == "ben" and i + 1 < len(tokens) and tokens[i + 1].strip(".,;:!?…").lower() in ("euh", "heu"):
            continue
        kept.append(tok)
    text = " ".join(kept)
    return text if _TOKEN.search(text) else ""


def spoken_pieces(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """Pieces of speech of all lines: workspace_id, t_ms, idx, piece, speaker, end_ms, text. Repeated lines count once."""
    lower = F.lower(F.trim("display_name"))
    entries = F.explode(F.array(lower, F.split(lower, r"\s+")[0]))
    names = (
        profiles.where("display_name is not null and speaker is not null")
        .select("workspace_id", entries.alias("name"), "speaker")
        .groupBy("workspace_id")
        .agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "name", "speaker"))), "|").alias("names"))
    )
    rows = (
        lines.select("workspace_id", "idx", "speaker", "start_s", "end_s", "source_text")
        .where("source_text is not null")
        .dropDuplicates(["workspace_id", "idx", "speaker", "start_s", "end_s", "source_text"])
    )
    joined = rows.join(names.withColumnRenamed("workspace_id", "r_ws"), F.col("workspace_id").eqNullSafe(F.col("r_ws")), "left").drop("r_ws")

    def run(batches):
        import math

        import pyarrow as pa

        known = functools.lru_cache(256)(lambda s: dict(x.split("=", 1) for x in s.split("|")) if s else {})
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("workspace_id", "t_ms", "idx", "piece", "speaker", "end_ms", "text")}
            for r in b.to_pylist():
                stated, found = pieces(r["source_text"], r["speaker"], known(r["names"] or ""))
                start, end = ((round(x * 1000) if x is not None and math.isfinite(x) else None) for x in (r["start_s"], r["end_s"]))
                t = next((x for x in (start, stated, end) if x is not None), None)
                for i, (who, text) in enumerate(found):
                    for k, v in zip(out, (r["workspace_id"], t, r["idx"], i, who, end if end is not None else t, text), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(
                out,
                schema=pa.schema([("workspace_id", pa.string()), ("t_ms", pa.int64()), ("idx", pa.int64()), ("piece", pa.int32()), ("speaker", pa.string()), ("end_ms", pa.int64()), ("text", pa.string())]),
            )

    return joined.mapInArrow(run, "workspace_id string, t_ms bigint, idx bigint, piece int, speaker string, end_ms bigint, text string")


def without_rolling(found: DataFrame, min_overlap: int = 5) -> DataFrame:
    """Drop words at the head of a piece that repeat the tail of the piece before (same speaker, ``min_overlap`` words or more)."""
    words = F.transform(F.split("text", r"\s+"), lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    rows = with_previous(found.withColumn("words", words), ["workspace_id"], ["t_ms", "idx", "piece"], ["speaker", "words"])
    before, here = F.col("previous.words"), F.col("words")
    longest = F.least(F.size(before), F.size(here))
    fits = F.filter(
        F.when(longest >= min_overlap, F.sequence(F.lit(min_overlap), longest)),
        # both ends first, so that a long piece compares whole stretches for few lengths
        lambda k: (F.get(before, F.size(before) - k) == F.get(here, F.lit(0))) & (F.get(before, F.size(before) - 1) == F.get(here, k - 1)) & (F.slice(before, F.size(before) - k + 1, k) == F.slice(here, F.lit(1), k)),
    )
    cut = F.when(F.col("previous.speaker").eqNullSafe(F.col("speaker")), F.array_max(fits))
    rows = rows.withColumn("cut", F.coalesce(cut, F.lit(0)))
    kept = F.array_join(F.slice(F.split("text", r"\s+"), F.col("cut") + 1, F.greatest(F.lit(0), F.size("words") - F.col("cut"))), " ")
    return rows.withColumn("text", F.when(F.col("cut") > 0, kept).otherwise(F.col("text"))).where("text <> ''").drop("words", "previous", "cut")


def calibrated_pause(found: DataFrame, share: float = 0.99) -> DataFrame:
    """Pause (ms) per workspace that only 1 - ``share`` of the pauses between neighbouring pieces exceed."""
    rows = with_previous(found, ["workspace_id"], ["t_ms", "idx", "piece"], ["end_ms"])
    pause = F.col("t_ms") - F.col("previous.end_ms")
    return rows.groupBy("workspace_id").agg(F.percentile_approx(F.when(pause > 0, pause), share, 1000).alias("pause_ms"))


def turn_marks(lines: DataFrame, profiles: DataFrame, split_pauses: bool = False, min_overlap: int = 5) -> DataFrame:
    """Pieces with ``run``, the order key of the first piece of their turn."""
    found = without_rolling(written(spoken_pieces(lines, profiles), "pieces"), min_overlap)  # texts are taken apart once
    if split_pauses:
        limit = calibrated_pause(found).withColumnRenamed("workspace_id", "r_ws")
        found = found.join(limit, F.col("workspace_id").eqNullSafe(F.col("r_ws")), "left").drop("r_ws")
    else:
        found = found.withColumn("pause_ms", F.lit(None).cast("bigint"))

    def same(prev, cur):
        return (prev["speaker"] == cur["speaker"]) & (cur["pause_ms"].isNull() | (cur["t_ms"] - prev["end_ms"] <= cur["pause_ms"]))

    return chunked_runs(found, ["workspace_id"], ["t_ms", "idx", "piece"], ["end_ms", "speaker", "pause_ms"], same)


def turn_bounds(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """Clean turns of known speakers, split at speaker changes only: workspace_id, speaker, first_idx, last_idx.

    Lines are ordered by start, else by the time their text states, else by their end; then by ``idx``. Lines without
    words, null texts and pieces of unknown speakers give no turn (the latter do end one). Repeated lines count once;
    a workspace without profiles still resolves numbered labels; an empty table gives an empty result.
    """
    order = F.struct("t_ms", "idx", "piece")
    return (
        turn_marks(lines, profiles)
        .groupBy("workspace_id", "run")
        .agg(F.min("speaker").alias("speaker"), F.min_by("idx", order).alias("first_idx"), F.max_by("idx", order).alias("last_idx"))
        .where("speaker is not null")
        .select("workspace_id", "speaker", "first_idx", "last_idx")
    )


def clean_turns(lines: DataFrame, profiles: DataFrame) -> DataFrame:
    """Clean turns with their text, split at speaker changes and at pauses longer than calibrated for the workspace."""
    marked = turn_marks(lines, profiles, split_pauses=True)
    parts = F.array_sort(F.collect_list(F.struct("t_ms", "idx", "piece", "text")))
    return (
        marked.groupBy("workspace_id", "run")
        .agg(F.min("speaker").alias("speaker"), F.min("t_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), parts.alias("parts"))
        .select(
            "workspace_id", F.coalesce("speaker", F.lit("speaker_unknown")).alias("speaker"), "start_ms", "end_ms",
            F.col("parts")[0]["idx"].alias("first_idx"), F.element_at("parts", -1)["idx"].alias("last_idx"),
            F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"),
        )
    )
