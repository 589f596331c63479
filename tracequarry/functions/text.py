"""Text and JSON scalars as built-in column expressions."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

#: Headers of a turn prompt, the marker before responses.
SECTIONS = ("Task Instruction", "Current State", "Current Phone State", "Action", "Environment Observation")
RESPONSE_MARKER = "**Environment Observation:**"


def strip_instruction_suffix(prompt: Column, suffix: str) -> Column:
    return F.substring_index(prompt, suffix, 1) if suffix else prompt


def prompt_section(prompt: Column, name: str) -> Column:
    """The trimmed body under **name:** up to the next header; null without that header."""
    others = "|".join(SECTIONS)
    pattern = rf"(?is)(?:^|\n)\*\*{name}:\*\*[ \t]*\n?(.*?)(?=\n\*\*(?:{others}):\*\*|\z)"
    found = F.regexp_extract(prompt, pattern, 1)
    return F.when(prompt.rlike(rf"(?i)(^|\n)\*\*{name}:\*\*"), F.trim(found, F.lit(" \t\r\n")))


def prompt_turn(prompt: Column) -> Column:
    head = F.regexp_extract(prompt, r"(?is)\A(.*?)(?=\n\*\*(?:" + "|".join(SECTIONS) + r"):\*\*|\z)", 1)
    return F.nullif(F.regexp_extract(head, r"###\s*Turn\s*(\d+)", 1), F.lit("")).cast("int")


def prompt_sections(prompt: Column) -> Column:
    return F.struct(prompt_turn(prompt).alias("turn"), *(prompt_section(prompt, s).alias(s.lower().replace(" ", "_")) for s in SECTIONS))


def action_block(prompt: Column) -> Column:
    """(language, body) of the fenced block in the action section; the last fence closes it."""
    text = F.coalesce(prompt_section(prompt, "Action"), F.lit(""))
    fence = r"(?s)```([^\n]*)\n(.*)```"
    open_only = r"(?s)```([^\n]*)\n(.*)"
    body = F.when(text.rlike(fence), F.regexp_extract(text, fence, 2)).when(text.rlike(open_only), F.regexp_extract(text, open_only, 2)).otherwise(text)
    return F.struct(F.lower(F.trim(F.regexp_extract(text, open_only, 1))).alias("language"), F.trim(body, F.lit(" \t\r\n")).alias("body"))


def clean_response_marker(text: Column) -> Column:
    return F.trim(F.replace(text, F.lit(RESPONSE_MARKER), F.lit("")), F.lit(" \t\r\n"))


def mcp_arguments(text: Column) -> Column:
    """Arguments as a JSON object: empty -> {}, objects as they are, text that is no JSON -> {raw}, scalars -> {value}."""
    t = F.trim(text)
    parsed = F.try_parse_json(t)
    return (
        F.when(t.isNull() | t.isin("", "null"), F.lit("{}"))
        .when(parsed.isNull(), F.to_json(F.struct(text.alias("raw"))))
        .when(t.startswith("{"), t)
        .otherwise(F.concat(F.lit('{"value":'), t, F.lit("}")))
    )


def clip_text(text: Column, n: int) -> Column:
    """Head and tail of long texts around a mark of what is left out."""
    head = n // 2
    cut = F.length(text) - n
    return F.when(cut <= 0, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n...["), cut.cast("string"), F.lit(" characters omitted]...\n"), F.right(text, F.lit(n - head))))


def clip_head(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("...")))


def normalize_score(x: Column) -> Column:
    """1..5 to 0..100."""
    return (x - 1) / 4 * 100


def response_kind(value: Column) -> Column:
    """error / data / message / other of a JSON response."""
    is_object = F.trim(value).startswith("{")
    return F.when(~is_object | value.isNull(), "other").when(F.get_json_object(value, "$.success") == "false", "error").when(F.get_json_object(value, "$.data").isNotNull() | value.rlike(r'"data"\s*:\s*null'), "data").otherwise("message")


def normalize_page(url: Column) -> Column:
    """Lower-case scheme and host; without fragment, proxy parameter and trailing ?, & and /."""
    plain = F.regexp_replace(url, r"#.*$", "")
    plain = F.regexp_replace(plain, r"([?&])proxy=[^&]*&?", "$1")
    plain = F.regexp_replace(plain, r"[?&/]+$", "")
    head = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(plain, F.length(head) + 1))


#: Packages that every screen shows.
SYSTEM_PACKAGES = ("android", "com.android.systemui")


def screen_signature(text: Column) -> Column:
    """(state, app, items): the state id if the text has one, the most frequent app, its distinct resource ids (three
    at least, else none)."""
    state = F.nullif(F.regexp_extract(text, r"state[_ ]id[\"']?\s*[:=]\s*[\"']?([\w-]+)", 1), F.lit(""))
    ids = F.filter(F.regexp_extract_all(text, F.lit(r"([a-z][\w.]*):id/(\w+)"), F.lit(0)), lambda x: ~F.substring_index(x, ":", 1).isin(*SYSTEM_PACKAGES))
    apps = F.transform(ids, lambda x: F.substring_index(x, ":", 1))
    counted = F.transform(F.array_distinct(apps), lambda a: F.struct(F.size(F.filter(apps, lambda b: b == a)).alias("n"), a.alias("app")))
    app = F.array_max(counted)["app"]
    items = F.array_sort(F.array_distinct(F.filter(ids, lambda x: F.substring_index(x, ":", 1) == app)))
    return F.struct(state.alias("state"), app.alias("app"), F.when(F.size(items) >= 3, items).alias("items"))


#: File endings that make a name specific, names that are not.
FILE_ENDINGS = ("py", "sh", "c", "h", "cpp", "js", "ts", "json", "yaml", "yml", "toml", "txt", "md", "csv", "log", "html", "css", "sql", "conf", "cfg", "ini", "xml", "tar", "gz", "zip", "png", "jpg", "pdf")
GENERIC_NAMES = ("/", "/tmp", "/app", "/srv", "/opt", "/mnt", "/root", "/home", "/usr", "/etc", "/var", "/bin", "/dev/null", "README.md", "requirements.txt", "package.json", "setup.py", "index.html", "main.py", "test.py")


def specific_tokens(text: Column) -> Column:
    """Sorted distinct paths with their components, file names and long ids; urls, versions and generic names apart."""
    plain = F.regexp_replace(text, r"[a-zA-Z][a-zA-Z0-9+.-]*://\S+", " ")
    paths = F.transform(F.regexp_extract_all(plain, F.lit(r"(?:~|\.{1,2})?(?:/[\w.@+-]+)+"), F.lit(0)), lambda x: F.rtrim(x, F.lit("./")))
    files = F.regexp_extract_all(plain, F.lit(r"\b[\w-]+(?:\.[\w-]+)*\.(?:" + "|".join(FILE_ENDINGS) + r")\b"), F.lit(0))
    long_ids = F.regexp_extract_all(plain, F.lit(r"\b(?=[\w-]*\d)[A-Za-z][\w-]{11,}\b"), F.lit(0))
    parts = F.filter(F.flatten(F.transform(paths, lambda p: F.split(p, "/"))), lambda x: x.rlike(r"\.(" + "|".join(FILE_ENDINGS) + r")$"))
    every = F.array_distinct(F.concat(paths, files, long_ids, parts))
    return F.array_sort(F.filter(F.array_except(every, F.array(*map(F.lit, GENERIC_NAMES))), lambda x: (F.length(x) > 2) & ~x.rlike(r"^v?\d+(\.\d+)+$")))


def action_operands(action_json: Column) -> Column:
    """Specific names in an action's command lines and string arguments; payload fields are left out."""
    values = F.map_filter(F.from_json(action_json, "map<string,string>"), lambda k, v: ~k.isin("content", "text", "body", "new_str", "old_str", "file_text"))
    return specific_tokens(F.array_join(F.transform(F.map_values(values), lambda v: F.substring_index(v, "\n", 1)), " \n "))


PROMPT_LINE = r"^(?:\([\w.-]+\) )?([\w.-]+)@([\w.-]+):([^\s#$]*)\s?([#$]) ?(.*)$"


def shell_prompt_lines(events: DataFrame, id_cols: list[str], text: str) -> DataFrame:
    """One row per prompt line: line number, user, host, cwd, sigil, command, idle (nothing typed)."""
    lines = events.select(*id_cols, F.posexplode(F.split(text, "\n")).alias("line", "value")).where(F.col("value").rlike(PROMPT_LINE))
    part = lambda i: F.regexp_extract("value", PROMPT_LINE, i)
    return lines.select(*id_cols, "line", part(1).alias("user"), part(2).alias("host"), part(3).alias("cwd"), part(4).alias("sigil"), part(5).alias("command"), (F.trim(part(5)) == "").alias("idle"))


def prompt_signature(lines: DataFrame, id_cols: list[str]) -> DataFrame:
    """The most frequent (user, host, sigil) of each id and the cwd of its last line."""
    keyed = lines.groupBy(*id_cols, "user", "host", "sigil").agg(F.count("*").alias("n"), F.max_by("cwd", F.struct(*[c for c in ("pos",) if c in lines.columns], "line")).alias("cwd"))
    w = Window.partitionBy(*id_cols).orderBy(F.desc("n"), "user", "host", "sigil")
    return keyed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def transcript_cwd(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?m)^(?:\([\w.-]+\) )?[\w.-]+@[\w.-]+:([^\s#$]*)\s?[#$]"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


#: Fixed value: a row of a long listing, with the name (and a link's target) as its group.
LISTING_LINE = r"^[-bcdlps][-rwxsStT]{9}[.+@]?\s+\d+\s+\S+\s+\S+\s+[\d.]+[KMG]?\s+\S+\s+\d+\s+[\d:]+\s+(.+)$"


def transcript_names(events: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, name): what a transcript makes its own: specific names in commands typed behind a prompt and in JSON calls, and
    the entries of long listings (four characters or more, no generic ones). Output and file contents name nothing."""
    lines = F.split(text, "\n")
    group = lambda pattern, i: F.transform(F.filter(lines, lambda x: x.rlike(pattern)), lambda x: F.regexp_extract(x, pattern, i))
    typed = specific_tokens(F.array_join(group(PROMPT_LINE, 5), "\n"))
    listed = F.transform(group(LISTING_LINE, 1), lambda x: F.trim(F.substring_index(x, " -> ", 1)))
    listed = F.filter(F.array_except(listed, F.array(*map(F.lit, GENERIC_NAMES))), lambda x: F.length(x) >= 4)
    calls = F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(\{.*?\})\s*```"), F.lit(1))
    named = F.flatten(F.transform(calls, lambda c: action_operands(F.get_json_object(c, "$.arguments"))))
    return events.select(F.col(id_col), F.explode(F.array_distinct(F.concat(typed, listed, named))).alias("name")).distinct()


def wait_state(previous: Column) -> Column:
    """(state, command, tail) of what the last line of an observation says about a running program."""
    lines = F.filter(F.split(previous, "\n"), lambda x: F.trim(x) != "")
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(F.lit(""))
    command = F.trim(F.regexp_extract(last, PROMPT_LINE, 5))
    state = F.when(last.rlike(PROMPT_LINE) & (command == ""), "idle_prompt").when(last.rlike(PROMPT_LINE), "command_typed_no_output_yet").otherwise("program_output_in_progress")
    return F.struct(state.alias("state"), F.nullif(command, F.lit("")).alias("command"), F.right(last, F.lit(80)).alias("tail"))


def clean_tool_description(text: Column) -> Column:
    """Without the Returns and Constraints sections: a section ends at the next header or blank line."""
    return F.trim(F.regexp_replace(text, r"(?im)^[ \t]*(?:returns|constraints)\s*:[ \t]*(?:.*)(?:\n(?![ \t]*\n|[ \t]*\w+\s*:\s*$).*)*\n?", ""), F.lit(" \t\r\n"))


def query_tokens(text: Column, n: int = 12) -> Column:
    """The first n distinct word-like tokens; flags and quotes dropped."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(^|\s)--?[A-Za-z][\w-]*", " "), "[\"'`]", " ")
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(plain), F.lit(r"[\w./@:-]{2,}"), F.lit(0)), lambda x: x.rlike(r"\w"))), 1, n)


def observation_snippet(text: Column, tokens: Column, width: int) -> Column:
    """A window of text around the first place of any token."""
    at = F.array_min(F.filter(F.transform(tokens, lambda t: F.instr(F.lower(text), t)), lambda i: i > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - width // 4)
    return F.substr(text, start, F.lit(width))


def page_text(text: Column, offset: Column, length: int) -> Column:
    """(part, next offset or null)."""
    length = F.lit(length)
    return F.struct(F.substr(text, offset + 1, length).alias("part"), F.when(F.length(text) > offset + length, offset + length).alias("next_offset"))


def action_kind(prompt: Column) -> Column:
    """wait / heredoc / keys / batch / single / unparsed of a keystroke prompt."""
    body = action_block(prompt)["body"]
    keys = F.from_json(body, "array<struct<keystrokes:string,duration:double>>")
    text = F.array_join(F.transform(keys, lambda k: F.coalesce(k["keystrokes"], F.lit(""))), "")
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))
    return F.when(keys.isNull(), "unparsed").when(F.trim(text, F.lit(" \n\t")) == "", "wait").when(text.contains("<<"), "heredoc").when(~text.endswith("\n"), "keys").when(lines > 1, "batch").otherwise("single")


def turn_tags(command: Column, history: Column, turn: Column, observation: Column) -> Column:
    """Tags: reads what an earlier turn wrote, names an error, follows a cd, is late."""
    wrote = F.flatten(F.transform(history, lambda h: F.regexp_extract_all(h, F.lit(r"(?:>>?|tee(?: -a)?|touch|cp \S+|mv \S+)\s*([\w./-]+)"), F.lit(1))))
    reads = F.regexp_extract_all(command, F.lit(r"\b(?:cat|head|tail|less|grep|sed|awk|wc|python3?|bash|sh)\s+(?:-\S+\s+)*([\w./-]+)"), F.lit(1))
    return F.array_compact(F.array(
        F.when(F.arrays_overlap(reads, wrote), F.lit("state_read")),
        F.when(observation.rlike(r"(?i)\b(error|traceback|no such file|not found|denied)\b"), F.lit("state_error")),
        F.when(F.exists(history, lambda h: h.rlike(r"(^|[;&\n]\s*)cd\s+\S")), F.lit("after_cd")),
        F.when(turn >= 20, F.lit("long_horizon")),
    ))


def has_html_entities(text: Column) -> Column:
    return text.rlike(r"&(?:[a-zA-Z]{2,8}|#\d{2,5}|#x[0-9a-fA-F]{2,5});")


def style_of(tools: Column, styles: dict[str, list[str]]) -> Column:
    """The style whose tool names occur most; ties by name."""
    counted = F.array(*(F.struct(F.size(F.array_intersect(tools, F.array(*map(F.lit, names)))).alias("n"), F.lit(style).alias("style")) for style, names in sorted(styles.items(), reverse=True)))
    best = F.array_max(counted)
    return F.when(best["n"] > 0, best["style"]).otherwise("other")


def scaffold_of(tools: Column, scaffolds: dict[str, list[str]]) -> Column:
    """The first scaffold, in the order given, all of whose tools are at hand."""
    out = F.lit("other")
    for name, needed in reversed(scaffolds.items()):
        out = F.when(F.size(F.array_except(F.array(*map(F.lit, needed)), tools)) == 0, name).otherwise(out)
    return out


def site_of(text: Column, sites: dict[str, str]) -> Column:
    """The first site whose marker the text contains."""
    out = F.lit("other")
    for marker, site in reversed(sites.items()):
        out = F.when(text.contains(marker), site).otherwise(out)
    return out


def primary_app(rows: DataFrame, key: str, app: str) -> DataFrame:
    """The app that most rows of a key show; ties by name."""
    counted = rows.where(F.col(app).isNotNull()).groupBy(key, app).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.min_by(app, F.struct(-F.col("n"), app)).alias(app))


def strip_screen_wrapper(text: Column) -> Column:
    """Without a warnings block and the screen header lines."""
    plain = F.regexp_replace(text, r"(?s)\A(?:Previous response had warnings:.*?\n\n)", "")
    plain = F.regexp_replace(plain, r"\A(?:New Terminal Output|Current Terminal Screen|Current terminal state|Terminal Output)\s*:\s*\n", "")
    return F.trim(plain, F.lit("\n"))


def final_answer(text: Column) -> Column:
    """(kind, answer) of the first line `FINAL ANSWER: ...` or `DONE ...`."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("FINAL ANSWER:") | x.startswith("DONE"))
    first = F.get(lines, F.lit(0))
    return F.when(first.startswith("FINAL ANSWER:"), F.struct(F.lit("answer").alias("kind"), F.trim(F.substring(first, 14, 1 << 30)).alias("text"))).when(first.isNotNull(), F.struct(F.lit("done").alias("kind"), F.substring(first, 1, 200).alias("text")))
