"""Corpus build: fingerprints, lines, symbols, attributes, descriptions, localisation, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattis.operators.running import running_sums
from lattis.session import keep

# Declarations that one line of a script can open, as (kind, pattern with the name as its group).
SYMBOL_RULES = [
    ("include", r"""^\s*#include\s+["<]([^">]+)[">]"""),
    ("class", r"^\s*(?:(?:shared|abstract|final|external)\s+)*class\s+([A-Za-z_]\w*)"),
    ("interface", r"^\s*(?:(?:shared|abstract|final|external)\s+)*interface\s+([A-Za-z_]\w*)"),
    ("mixin", r"^\s*(?:(?:shared|abstract|final|external)\s+)*mixin\s+([A-Za-z_]\w*)"),
    ("namespace", r"^\s*namespace\s+([A-Za-z_][\w:]*)"),
    ("enum", r"^\s*(?:shared\s+)?enum\s+([A-Za-z_]\w*)"),
    ("funcdef", r"^\s*(?:shared\s+)?funcdef\s+[A-Za-z_][\w:<>@&\[\]]*\s+([A-Za-z_]\w*)\s*\("),
    ("function", r"^\s*(?:(?:private|protected|shared|abstract|final|external|override|explicit|const)\s+)*[A-Za-z_][\w:]*(?:<[^<>]*>)?[@&]?\s+([A-Za-z_]\w*)\s*\("),
]
CONTROL_WORDS = "if|for|while|switch|return|else|do|catch|case|break|continue|new|delete|throw"
# Languages whose names are indexed.
INDEXED_LANGUAGES = ["cn", "zh", "zh_cn", "zh-cn", "chinese", "en", "english"]
# Sentences of a description by entity type: (field aliases, after `specification.` too unless they begin with =; format; another
# format; mode). The other format is for values other than 1 (flag, the mode if there is another format), for 0 (zero), or for values without a sign,
# above 0 and else (sign); a sentence of mode any needs a 1 among the values.
TEMPLATES = {
    "weapon": [
        ("class|weapon_class", "This is a weapon of class {}.", None), ("damage", "It deals {} base damage per shot.", None), ("magazine_size", "It has a magazine capacity of {} rounds.", None),
        ("rpm", "Its rate of fire is {} rounds per minute.", None), ("range", "Its effective range is {} meters.", None), ("vehicle_damage", "Its vehicle damage multiplier is {}.", None),
        ("suppress_factor", "Its suppression factor is {}.", None), ("barrel_offset", "It has a barrel offset of {}.", None), ("sight_range", "Its sight range modifier is {}.", None), ("slot", "It occupies weapon slot {}.", None),
        ("carry_in_back", "It can be carried on the back.", "It cannot be carried on the back."),
    ],
    "projectile": [
        ("damage", "This projectile deals {} damage on impact.", None), ("time_to_live", "It travels for up to {} seconds before expiring.", None), ("speed", "Its base speed is {} m/s.", None),
        ("drag_constant", "It has a drag constant of {}, affecting its trajectory.", None), ("blast_damage", "Its explosion deals {} blast damage.", None), ("blast_radius", "Its blast radius is {} meters.", None),
        ("bounciness", "Its bounciness factor is {}.", None), ("hit_radius", "Its hit detection radius is {} meters.", None), ("can_shoot_down", "It can be shot down by enemy fire.", "It cannot be shot down."),
    ],
    "vehicle": [
        ("class|vehicle_class", "This is a class {} vehicle.", None), ("max_speed", "Its maximum speed is {} m/s.", None), ("acceleration", "Its acceleration is {}.", None), ("max_hitpoints", "It has {} hit points.", None),
        ("armor", "Its armor rating is {}.", None), ("seat_count", "It can carry {} occupants.", None), ("weapon", "Its primary weapon is {}.", None), ("turret", "It is equipped with a {} turret.", None),
    ],
    "soldier": [
        ("=spawn_score", "This soldier has a spawn score of {}.", None), ("=squad_size_xp_cap", "The squad size XP cap for this soldier is {}.", None), ("=copy_from", 'It is based on the soldier template "{}".', None),
        ("=faction", "It belongs to the {} faction.", None),
    ],
    "call": [
        ("=name", 'This call is named "{}".', None), ("=initiation_comment1", 'When initiated, the operator says: "{}".', None), ("=type", "Its call type is {}.", None), ("=cooldown", "It has a cooldown of {} seconds.", None),
        ("=cost", "It costs {} to call.", None),
    ],
    "character": [("=name", "Character name: {}.", None), ("=faction", "Faction: {}.", None), ("=appearance", "Appearance variant: {}.", None)],
    "carry_item": [
        ("=name", 'This carry item is named "{}".', None), ("=slot", "It occupies carry slot {}.", None), ("=inventory.encumbrance", "It has an encumbrance of {}.", None), ("=inventory.price", "Its price is {}.", None),
        ("=commonness.value", "Its spawn commonness is {}.", "It cannot be found naturally in the game world (commonness: 0).", "zero"),
        ("=commonness.in_stock", "It is available in stock.", "It is not available in stock."), ("=commonness.can_respawn_with", "Players can respawn with it.", "Players cannot respawn with it."),
        ("=transform_on_consume", 'When consumed or used, it transforms into "{}".', None),
        ("=modifier.speed", "It modifies movement speed by {}.", "It increases movement speed by {}.|It does not change movement speed.", "sign"),
        ("=modifier.hit_success_probability", "It modifies hit probability by {}.", "It increases hit probability by {}.|It does not change hit probability.", "sign"),
        ("=modifier.detectability", "It modifies detectability by {}.", "It increases detectability by {}.|It does not change detectability.", "sign"),
    ],
}
TEMPLATES["weapon"] += [
    ("=next_in_chain.key[]|next_in_chain.key", "It can switch to the following weapon mode(s): {}. This represents an alternative fire mode such as an underbarrel grenade launcher or a skill variant.", None),
    ("=next_in_chain.share_ammo[]|next_in_chain.share_ammo", "Some of these modes share ammo with the current weapon.", "", "any"),
]


def fingerprint(manifest: DataFrame, *by: str) -> DataFrame:
    """Files and their latest modification (manifest: mtime), over all or by columns."""
    return manifest.groupBy(*by).agg(F.count("*").alias("files"), F.max("mtime").alias("max_mtime"))


def stale_reason(meta: DataFrame, current: DataFrame, by: str, version: int) -> DataFrame:
    """Why each index can't be used as it is; null if it can. The first reason counts.

    meta: by, version, root, files, max_mtime of the last build; current: by, root, files, max_mtime.
    """
    m, c = meta.alias("m"), current.alias("c")
    rows = m.join(c, F.col(f"m.{by}") == F.col(f"c.{by}"), "full_outer")
    reason = (
        F.when(F.col(f"m.{by}").isNull(), "missing").when(F.col("m.version") != version, "version").when(~F.col("m.root").eqNullSafe(F.col("c.root")), "root")
        .when(F.coalesce("c.files", F.lit(0)) != F.col("m.files"), "file count changed").when(F.col("c.max_mtime") > F.col("m.max_mtime"), "files modified")
    )
    return rows.select(F.coalesce(f"m.{by}", f"c.{by}").alias(by), reason.alias("reason"))


def text_documents(files: DataFrame) -> DataFrame:
    """One document for each opaque text file. files: package, path, content."""
    base = F.element_at(F.split("path", "/"), -1)
    ext = F.when(F.contains(base, F.lit(".")), F.element_at(F.split(base, r"\."), -1)).otherwise("")
    return files.select(
        "package", "path", F.lit("script_chunk").alias("type"), base.alias("key"), F.lit("PlainText").alias("label"),
        F.concat(F.lit("File: "), base, F.lit(" (type: "), ext, F.lit(")")).alias("description"), F.col("content").alias("raw_text"),
    )


def lines_of(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """Lines of a text from 1: keep, line_no, line."""
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def line_symbols(lines: DataFrame, rules: list[tuple[str, str]] = SYMBOL_RULES) -> DataFrame:
    """(file, line_no, kind, name, depth): what each line declares, by the first rule that fits; depth: braces open before it.

    lines: file, line_no, line. Braces are summed over the lines of a file; files without any never enter the window's
    sum with other than 0.
    """
    line = F.col("line")
    control = line.rlike(rf"^\s*(?:{CONTROL_WORDS})\b")
    found = F.coalesce(*[F.when(F.regexp_extract(line, p, 1) != "", F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, p, 1).alias("name"))) for kind, p in rules])
    # a pattern for what is no brace would be replaced character by character
    held = lambda brace: F.length(line) - F.length(F.replace(line, F.lit(brace), F.lit("")))
    delta = held("{") - held("}")
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    # only lines that declare or brace are needed
    rows = lines.select("file", "line_no", F.when(~control, found).alias("s"), delta.alias("delta")).where("s is not null or delta <> 0")
    rows = rows.withColumn("depth", F.coalesce(F.sum("delta").over(before), F.lit(0)).cast("long")).where("s is not null")
    return rows.select("file", "line_no", "s.kind", "s.name", "depth")


def symbol_summary(symbols: DataFrame, most: int = 120) -> DataFrame:
    """(file, kind, n, names): distinct names in order of appearance, the first `most` and how many more there are."""
    first = symbols.groupBy("file", "kind", "name").agg(F.min("line_no").alias("line_no"))
    rows = first.groupBy("file", "kind").agg(F.sort_array(F.collect_list(F.struct("line_no", "name"))).alias("s"))
    names = F.array_join(F.transform(F.slice("s", 1, most), lambda x: x["name"]), ", ")
    more = F.when(F.size("s") > most, F.concat(F.lit(" …+"), (F.size("s") - most).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select("file", "kind", F.size("s").cast("long").alias("n"), F.concat(names, more).alias("names"))


def symbol_lookup(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """(rid, kind, name, line_no, file): symbols of the file of a request's base name, in its package (null: any; symbols without one are in all). requests: rid, file, mod; symbols: file, kind, name, line_no, mod."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    asked = requests.select("rid", base(F.col("file")).alias("base"), F.col("mod").alias("scope"))
    hit = asked.join(symbols.withColumn("base", base(F.col("file"))), "base")
    return hit.where(F.col("scope").isNull() | F.col("mod").isNull() | (F.col("scope") == F.col("mod"))).select("rid", "kind", "name", "line_no", "file")


def restrict_packages(files: DataFrame, names: list[str], column: str = "package") -> DataFrame:
    """Files of the named packages; an error if none of them exists."""
    out = files.where(F.col(column).isin(names))
    if not out.limit(1).count():
        raise ValueError(f"no package of {names}")
    return out


def read_lines(requests: DataFrame, lines: DataFrame, most: int = 4000) -> DataFrame:
    """Line ranges of files: rid, file, n_lines (of the file), content, truncated, owner, out_of_scope.

    requests: rid, file, start, end (null: from the first, to the last), mod (null: any); lines: file, line_no, line,
    package. The join is on file, with the range as its condition; unknown files give no row.
    """
    sizes = lines.join(requests.select("file").distinct(), "file", "left_semi").groupBy("file").agg(F.max("line_no").alias("n_lines"), F.min("package").alias("owner"))
    inside = (F.col("line_no") >= F.coalesce("start", F.lit(1))) & (F.col("line_no") <= F.coalesce("end", F.lit(2147483647)))
    got = requests.join(lines.select("file", "line_no", "line"), "file").where(inside)
    got = got.groupBy("rid", "file", "mod").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("all"))
    cut = F.length("all") > most
    return got.join(sizes, "file").select(
        "rid", "file", "n_lines", F.when(cut, F.concat(F.substring("all", 1, most), F.lit("\n... [truncated]"))).otherwise(F.col("all")).alias("content"), cut.alias("truncated"),
        "owner", (F.col("mod").isNotNull() & (F.col("mod") != F.col("owner"))).alias("out_of_scope"),
    )


def _leaves(kind: T.StructType, value: Column, prefix: str) -> list[Column]:
    """Arrays of (path, values) of a struct; repeated elements give their values in order."""
    out = []
    for f in kind.fields:
        path, v = f"{prefix}.{f.name}" if prefix else f.name, value[f.name]
        if isinstance(f.dataType, T.StructType):
            out += _leaves(f.dataType, v, path)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            for g in f.dataType.elementType.fields:
                out.append(F.struct(F.lit(f"{path}.{g.name}").alias("path"), F.transform(v[g.name], lambda x: x.cast("string")).alias("values")))
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.struct(F.lit(path).alias("path"), v.cast("array<string>").alias("values")))
        else:
            out.append(F.struct(F.lit(path).alias("path"), F.array(v.cast("string")).alias("values")))
    return out


def flatten_attributes(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of a nested record: dotted paths; of repeats the last value, and all of them under `path[]`."""
    kind = df.schema[column].dataType
    rows = df.select(key, F.explode(F.array(*_leaves(kind, F.col(column), ""))).alias("a")).select(key, "a.path", F.array_compact("a.values").alias("v")).where("size(v) > 0")
    last = F.struct(F.col("path").alias("path"), F.element_at("v", -1).alias("value"))
    every = F.struct(F.concat("path", F.lit("[]")).alias("path"), F.array_join("v", ", ").alias("value"))
    return rows.select(key, F.explode(F.when(F.size("v") > 1, F.array(last, every)).otherwise(F.array(last))).alias("x")).select(key, "x.path", "x.value")


def first_present(attrs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(entity, field, value): the first non-empty among the aliases of a field. aliases: field, ord, path (a small table)."""
    rows = attrs.where("value is not null and value <> ''").join(aliases, "path")
    return rows.groupBy("entity", "field").agg(F.min_by("value", "ord").alias("value"))


def template_rows(templates: dict = TEMPLATES) -> list[tuple]:
    """(type, ord, alias_ord, path, format, other, mode) of a template table."""
    out = []
    for kind, rows in templates.items():
        for i, (aliases, text, other, *mode) in enumerate(rows):
            paths = aliases.removeprefix("=").split("|")
            paths += [] if aliases[0] == "=" else [f"specification.{x}" for x in paths]
            out += [(kind, i, j, path, text, other, mode[0] if mode else "plain" if other is None else "flag") for j, path in enumerate(paths)]
    return out


def describe(attrs: DataFrame, templates: dict = TEMPLATES) -> DataFrame:
    """(entity, description): a sentence for each template field of the entity's type that is present. attrs: entity, type, path, value."""
    rules = attrs.sparkSession.createDataFrame(template_rows(templates), "type string, ord int, alias_ord int, path string, format string, other string, mode string")
    rows = attrs.where("value is not null and value <> ''").join(F.broadcast(rules), ["type", "path"])
    picked = rows.groupBy("entity", "ord", "format", "other", "mode").agg(F.min_by("value", "alias_ord").alias("value"))
    mode, value, filled = F.col("mode"), F.col("value"), lambda c: F.replace(c, F.lit("{}"), F.col("value"))
    number, unsigned = value.try_cast("double"), F.split("other", r"\|")
    sentence = F.when((mode == "flag") & (value != "1") | (mode == "zero") & F.coalesce(number == 0, F.lit(False)), F.col("other"))
    sentence = sentence.when((mode == "sign") & ~value.rlike("^[+-]"), F.when(number > 0, filled(unsigned[0])).otherwise(unsigned[1]))
    sentence = sentence.when((mode == "any") & ~value.rlike("(^|, )1(,|$)"), F.lit(None)).otherwise(filled(F.col("format")))
    return picked.groupBy("entity").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", sentence.alias("s")))), lambda x: x["s"]), " ").alias("description"))


def effective_attributes(attrs: DataFrame, closure: DataFrame, append: list[str]) -> DataFrame:
    """(entity, path, pos, value, depth): attributes through inheritance.

    attrs: owner, path, pos, value; closure: entity, ancestor, depth (0: itself). The nearest layer that has a top-level
    key supplies all paths under it; keys in `append` come from all layers, the farthest first. `file` is not inherited.
    """
    rows = closure.join(attrs, closure["ancestor"] == attrs["owner"])
    rows = rows.withColumn("top", F.split("path", r"\.")[0]).where("top <> 'file' or depth = 0")
    near = Window.partitionBy("entity", "top")
    rows = rows.withColumn("nearest", F.min("depth").over(near))
    rows = rows.where(F.col("top").isin(append) | (F.col("depth") == F.col("nearest")))
    order = Window.partitionBy("entity", "path").orderBy(F.desc("depth"), "pos")
    return rows.select("entity", "path", (F.row_number().over(order) - 1).alias("pos"), "value", "depth")


def expand_includes(rows: DataFrame, most: int = 10) -> DataFrame:
    """(root, path, ord, value): rows that only name a file are replaced by that file's rows, again and again.

    rows: path, ord, include (null: a row of its own), value. A file inside itself is left out; at most `most` levels.
    ord is an array that sorts as the expanded rows read.
    """
    frontier = rows.select(F.col("path").alias("root"), F.array("path").alias("seen"), F.array("ord").alias("at"), "include", "value")
    done = frontier.where("include is null")
    todo = frontier.where("include is not null")
    for _ in range(most):
        step = todo.alias("t").join(rows.alias("r"), (F.col("t.include") == F.col("r.path")) & ~F.array_contains(F.col("t.seen"), F.col("r.path")))
        step = step.select("t.root", F.array_append("t.seen", F.col("r.path")).alias("seen"), F.array_append("t.at", F.col("r.ord")).alias("at"), F.col("r.include").alias("include"), F.col("r.value").alias("value"))
        step = keep(step)  # a level is computed once, not anew by each later one
        done = done.unionByName(step.where("include is null"))
        todo = step.where("include is not null")
        if not todo.limit(1).count():
            break
    return done.select("root", F.element_at("seen", -1).alias("path"), F.col("at").alias("ord"), "value")


def name_candidates(docs: DataFrame) -> DataFrame:
    """(id, cand_ord, name): names a document may be translated by. docs: id, type, spec_name, name, comment."""
    spec = F.coalesce(F.nullif("spec_name", F.lit("")), F.nullif("name", F.lit("")))
    names = F.array(spec, F.when(F.col("type") == "call", F.nullif("comment", F.lit(""))), F.when(F.instr(spec, "-") > 0, F.split(spec, "-")[0]))
    return docs.select("id", F.posexplode(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))).alias("cand_ord", "name"))


def localize(docs: DataFrame, translations: DataFrame) -> DataFrame:
    """(id, lang, cand_ord, name, text): translations of a document's names. translations: lang, ord, key, text; the last of a key counts."""
    # a text's aggregate sorts its rows: they are dealt out first, as a small file of many rows is read by one task
    n = int(translations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = translations.repartition(n, "lang", "key", "ord").groupBy("lang", "key").agg(F.max_by("text", "ord").alias("text"))
    return name_candidates(docs).join(last.withColumnRenamed("key", "name"), "name").select("id", "lang", "cand_ord", "name", "text")


def localized_name(localized: DataFrame, lang: str) -> DataFrame:
    """(id, text): the name of each document in a language, by the priority of its candidates."""
    return localized.where((F.col("lang") == lang) & (F.col("text") != "")).groupBy("id").agg(F.min_by("text", "cand_ord").alias("text"))


def indexed_names(localized: DataFrame) -> DataFrame:
    """(id, names): distinct names in the indexed languages, by language and candidate."""
    rows = localized.where(F.lower("lang").isin(INDEXED_LANGUAGES) & (F.col("text") != ""))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("lang", "cand_ord", "text"))), lambda x: x["text"])
    return rows.groupBy("id").agg(F.array_join(F.array_distinct(ordered), " ").alias("names"))


def render_content(docs: DataFrame, snippet: int = 500) -> Column:
    """The searchable content of a document; columns type, key, label, weapon_class, faction, name, localized, description, attributes, raw_text; null or empty sections drop out."""
    have = lambda c: F.when(F.trim(c) != "", F.col(c))
    tags = [F.concat(F.lit(f"[{label}: "), have(c), F.lit("]")) for label, c in (("Class", "weapon_class"), ("Faction", "faction"), ("Name", "name")) if c in docs.columns]
    head = F.concat(F.concat_ws(" ", F.concat(F.lit("[Type: "), "type", F.lit("]")), F.concat(F.lit("[Key: "), "key", F.lit("]")), *tags), F.lit("\n"), "label", F.lit(": "), "key")
    sections = [F.concat(F.lit(f"{title}:{gap}"), F.trim(have(c))) for title, gap, c in (("Localized Names", " ", "localized"), ("Description", " ", "description"), ("Attributes", "\n", "attributes")) if c in docs.columns]
    raw = F.substring("raw_text", 1, snippet)
    shown = F.when(F.col("type").isin("script_chunk", "resource") & (F.trim(F.regexp_replace(raw, r"\s+", " ")) != ""), F.concat(F.lit("Content Snippet:\n"), raw))
    return F.concat_ws("\n\n", head, *sections, shown)


def to_documents(entities: DataFrame) -> DataFrame:
    """Adds id `package:type:key:seq` and the effective key. entities: package, type, key, name, filename, file_ord, pos; seq counts in a package."""
    key = F.coalesce("key", "name", "filename", F.concat(F.col("type"), F.lit("_"), F.col("pos").cast("string")))
    rows = running_sums(entities.withColumn("key", key), "package", [F.col("file_ord"), F.col("pos")], seq=F.lit(1)).withColumn("seq", F.col("seq") - 1)
    return rows.withColumn("id", F.concat_ws(":", "package", "type", "key", F.col("seq").cast("string")))


def compare_entities(attrs: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each path, a column for each chosen entity. attrs: entity, path, pos, value; the first value counts."""
    return attrs.where(F.col("entity").isin(keys)).groupBy("path").pivot("entity", keys).agg(F.min_by("value", "pos"))


def labelled_entries(lines: DataFrame) -> DataFrame:
    """(file, line_no, key, index, label): dictionary entries under the comment line that labels them.

    lines: file, line_no, line. A label holds until the next one, or a blank line after an entry used it. Entries with an
    empty key or the key 666 don't count.
    """
    line = F.trim("line")
    entry = F.regexp_extract(line, r'\{\s*"([^"]*)"\s*,\s*(-?\d+)\s*\}', 1)
    index = F.regexp_extract(line, r'\{\s*"([^"]*)"\s*,\s*(-?\d+)\s*\}', 2)
    comment = F.when(line.startswith("//"), F.trim(F.substring(line, F.lit(3), F.length(line))))
    rows = lines.select("file", "line_no", F.when(comment != "", comment).alias("label"), F.when(~line.startswith("//") & (index != "") & ~entry.isin("", "666"), entry).alias("key"), index.try_cast("int").alias("index"), (line == "").alias("blank"))
    rows = rows.where("label is not null or key is not null or blank")
    # a blank line ends a label if an entry stands between the two
    order = Window.partitionBy("file").orderBy("line_no")
    rows = rows.withColumn("group", F.sum(F.col("label").isNotNull().cast("int")).over(order))
    inside = Window.partitionBy("file", "group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("used", F.coalesce(F.max(F.col("key").isNotNull().cast("int")).over(inside), F.lit(0)))
    rows = rows.withColumn("ended", F.max((F.col("blank") & (F.col("used") == 1)).cast("int")).over(inside)).withColumn("held", F.first("label").over(inside))
    return rows.where("key is not null").select("file", "line_no", "key", "index", F.when(F.col("ended") == 1, "").otherwise(F.coalesce("held", F.lit(""))).alias("label"))


# Modifier classes that tell what a protection does.
PROTECTION_CLASSES = {"hit_success_probability": "chance to be hit", "kill_probability": "chance to be killed", "damage": "damage"}


def hit_protection(modifiers: DataFrame, classes: dict[str, str] = PROTECTION_CLASSES) -> DataFrame:
    """(entity, facts): labelled modifiers whose input state is death, in order. modifiers: entity, pos, class, input, output, value."""
    label = F.element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), F.col("class"))
    rows = modifiers.where((F.col("input") == "death") & F.col("class").isin(list(classes))).withColumn("fact", F.struct("pos", label.alias("label"), "output", "value"))
    return rows.groupBy("entity").agg(F.transform(F.sort_array(F.collect_list("fact")), lambda f: F.concat_ws(" ", f["label"], f["output"], f["value"])).alias("facts"))
