"""Questions and answers as tables: routes, citations, assessment, calibrated confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Certainty terms of an assessment by the confidence they stand for, weakest first.
BANDS = (
    (15, ("cannot be determined", "cannot be answered", "no supporting evidence", "does not support", "unable to assess", "out of scope", "no evidence to support")),
    (35, ("weak", "limited", "inconclusive", "insufficient", "tentative", "speculative", "unclear", "cannot confirm", "cannot be confirmed", "cannot rule out", "not confirmed", "low certainty", "minimal")),
    (60, ("moderate", "partial", "uncertain", "uncertainty", "suggests", "suggestive", "possible", "possibly", "potential", "plausible", "circumstantial", "limits confidence", "may be", "might be", "plausibly", "indirect")),
    (85, ("strong", "strongly", "conclusive", "definitive", "directly", "high certainty", "well supported", "well-supported", "clearly", "unambiguous")),
)
UNQUALIFIED, CEILING = 50, 95
NO_RISK = ("insufficient-evidence", "unknown", "")
_DASH = "[-–—]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _words(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9.+_-]+"), F.lit(0)), " ")


def route_questions(questions: DataFrame, routes: list[tuple[str, list[str]]]) -> DataFrame:
    """questions(question, ...) with qid: the route whose keywords found in the question weigh most, the first of equals; null if none is found.
    A keyword weighs ten a word and one a character. The routes are a list in the plan, so nothing is joined."""
    text, best = F.col("_words"), []
    for place, (qid, keywords) in enumerate(routes):
        score = F.lit(0)
        for k in keywords:
            score = score + F.when(text.contains(_words(F.lit(k))), len(k.split()) * 10 + len(k)).otherwise(0)
        best.append(F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(qid).alias("qid")))
    top = F.array_max(F.array(*best))
    rows = questions.withColumn("_words", F.coalesce(_words(F.col("question")), F.lit(""))).withColumn("_top", top)
    return rows.withColumn("qid", F.when(F.col("_top.score") > 0, F.col("_top.qid"))).drop("_words", "_top")


def parse_citations(answers: DataFrame) -> DataFrame:
    """answers(raw, n_evidence, ...) with answer, confidence and citations: numbers from 1 to n_evidence, each once, in order of first sight.
    The patterns are fixed values."""
    text = _strip(F.coalesce("raw", F.lit("")))
    said = F.regexp_extract(text, r"(?i)confidences?[:\s]*(\d{1,3})", 1)
    clean = _strip(F.regexp_replace(text, r"(?im)^\s*confidences?[:\s]*\d{1,3}\s*$", ""))
    scanned = F.regexp_replace(clean, rf"\[(\d+)\]\s*{_DASH}\s*\[(\d+)\]", "[$1-$2]")
    groups = F.regexp_extract_all(scanned, F.lit(rf"\[(\d+(?:\s*(?:,|{_DASH})\s*\d+)*)\]"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))

    def numbers(part: Column) -> Column:
        first = F.regexp_extract(part, rf"^\s*(\d+)\s*(?:{_DASH}\s*\d+)?\s*$", 1).try_cast("long")
        last = F.regexp_extract(part, r"(\d+)\s*$", 1).try_cast("long")
        low, high = F.greatest(first, F.lit(1)), F.least(last, F.col("n_evidence").cast("long"))  # null last: beyond any count
        return F.when(first.isNotNull() & (low <= high), F.sequence(low, high)).otherwise(F.array().cast("array<long>"))

    cited = F.array_distinct(F.flatten(F.transform(parts, numbers)))
    return answers.withColumns({"answer": clean, "confidence": F.when(said != "", F.least(said.cast("int"), F.lit(100))), "citations": cited})


def build_references(matches: DataFrame) -> DataFrame:
    """matches(question_id, rank, ...) with number, from 1 for each question."""
    return matches.withColumn("number", F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "id")))


def cited_references(answers: DataFrame, references: DataFrame) -> DataFrame:
    """References that answers(question_id, citations) cite, with the place of the citation."""
    cites = answers.select("question_id", F.posexplode("citations").alias("place", "number"))
    return references.join(cites, ["question_id", "number"])


def assessment(answer: Column) -> Column:
    """The text between the heading ASSESSMENT and the next heading; empty without one. The headings are fixed values."""
    rest = F.get(F.split(answer, r"(?imd)^[\s*#_]*ASSESSMENT[\s*:_-]*$", 2), F.lit(1))
    section = F.get(F.split(rest, r"(?imd)^[\s*#_]*(?:GAPS|FINDING|EVIDENCE|CONFIDENCE)\b", 2), F.lit(0))
    return F.coalesce(_strip(section), F.lit(""))


def assessment_band(section: Column) -> Column:
    """What the weakest certainty term stands for; 50 without one."""
    text, band = F.lower(section), F.lit(None).cast("int")
    for value, terms in BANDS:
        found = F.lit(False)
        for t in terms:
            found = found | text.contains(t)
        band = F.coalesce(band, F.when(found, value))
    return F.coalesce(band, F.lit(UNQUALIFIED))


def coverage_cap(unavailable: Column, total: Column) -> Column:
    """30 if no source of a question is available, 70 if some are missing, else null."""
    return F.when((total > 0) & (unavailable > 0), F.when(unavailable >= total, 30).otherwise(70))


def calibrate(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """answers(question_id, answer, insufficient, unavailable_sources, total_sources, prior) with confidence.
    cited(question_id, risk_level) are the references that the answer cites. No cited risk: 10 less; a high one: 10 more; then the ceilings."""
    risk = F.lower(F.coalesce("risk_level", F.lit("")))
    of = cited.groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"), F.bool_or(risk == "high").alias("_high"), F.bool_and(risk.isin(*NO_RISK)).alias("_none"))
    value = assessment_band(assessment(F.col("answer"))) + F.when(F.col("_high"), 10).when(F.col("_none"), -10).otherwise(0)
    limits = [F.lit(CEILING), F.when(F.col("_n").isNull(), 25), F.when(F.col("insufficient"), BANDS[0][0]), coverage_cap(F.col("unavailable_sources"), F.col("total_sources")), F.col("prior").cast("int")]
    return answers.join(of, "question_id", "left").withColumn("confidence", F.greatest(F.lit(0), F.least(value, *limits))).drop("_n", "_high", "_none")


def malfind_ceiling(cited: DataFrame, region: Column) -> DataFrame:
    """(question_id, ceiling): 40 where every cited injected region is mapped; null where one is private or none is cited."""
    rows = cited.withColumn("_region", region)
    mapped, private = F.count_if(F.col("_region") == "MAPPED"), F.count_if(F.col("_region") == "PRIVATE-COMMITTED")
    return rows.groupBy("question_id").agg(F.when((mapped > 0) & (private == 0), 40).alias("ceiling"))


def evidence_confidence(references: DataFrame) -> DataFrame:
    """references(question_id, score, risk_level, has_flags, exact_match, quality) as a confidence of 0 to 100 for each question."""
    base = F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.coalesce(F.max("score"), F.lit(0.0)) * 100, 0).cast("int")))
    risk = F.when(F.coalesce(F.bool_or(F.col("risk_level") == "high"), F.lit(False)), 25).when(F.coalesce(F.bool_or(F.col("risk_level") == "medium"), F.lit(False)), 15).otherwise(0)
    plus = lambda flag, n: F.when(F.coalesce(F.bool_or(flag), F.lit(False)), n).otherwise(0)
    rows = references.groupBy("question_id").agg((base + risk + plus("has_flags", 10) + plus("exact_match", 15) + F.when(F.count(F.lit(1)) >= 2, 5).otherwise(0)).alias("c"), F.max("quality").alias("quality"))
    bounded = F.when(F.col("quality") == "structured", F.greatest("c", F.lit(60))).when(F.col("quality") == "general", F.least("c", F.lit(75))).when(F.col("quality") == "semantic", F.least("c", F.lit(65))).otherwise(F.col("c"))
    return rows.select("question_id", F.least(F.lit(100), F.greatest(F.lit(0), bounded)).alias("confidence"))


def apply_ceilings(confidence: Column, *ceilings: Column) -> Column:
    """The least of all that are not null."""
    return F.least(confidence, *ceilings)


#: Patterns and words of questions.
PID = r"(?i)\b(?:pids?|process(?:es)?)\s*(?:id|number)?\s*[:=#]?\s*(\d{1,10})\b"
TID = r"(?i)\b(?:tids?|threads?)\s*(?:id|number)?\s*[:=#]?\s*(\d{1,10})\b"
EXE = r"(?i)\b([a-zA-Z0-9_\-\.]+\.exe)\b"
SUSPICIOUS_WORDS = ("suspicious", "malware", "malicious", "malfind", "inject", "injected", "shellcode", "compromised", "infected", "ransomware", "rootkit", "threat", "threats", "anomaly", "anomalies", "risky", "risk", "dangerous", "unknown", "unusual", "stealthy")
PROCESS_WORDS = ("process", "processes", "pslist", "pstree", "running", "executable", "activity", "behavior", "behaviour", "did", "doing")
FAMILY_WORDS = {
    "netscan": ("network", "networking", "connection", "connections", "socket", "port", "ports", "listen", "listening", "remote", "tcp", "udp", "traffic", "connect", "connected", "ip"),
    "filescan": ("file", "files", "deleted", "disk"),
    "cmdline": ("command", "commands", "cmdline", "argument", "arguments", "launch"),
    "dlllist": ("dll", "module", "modules", "library", "libraries"),
    "handles": ("handle", "handles", "permission", "granted"),
    "printkey": ("registry", "regkey", "key", "hive", "printkey"),
    "malfind": ("shellcode", "vad", "executable memory"),
}
BARE_NAMES = ("powershell", "cmd", "wscript", "cscript", "mshta", "rundll32", "regsvr32", "wmiprvse", "explorer", "taskhost", "conhost", "dllhost", "splwow64", "vmtoolsd", "vmware", "mimikatz", "launcher", "malware", "tor")
PROCESS_FAMILIES = ("pslist", "pstree", "cmdline", "malfind")


def _whole(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike(r"\b(?:" + "|".join(words) + r")\b")


def detect_intent(questions: DataFrame) -> DataFrame:
    """questions(question, ...) with pid, tid, process_names, suspicious and families, as far as the text names them; null is empty text."""
    text = F.coalesce("question", F.lit(""))
    low, number = F.lower(text), lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    exe = F.transform(F.regexp_extract_all(text, F.lit(EXE), F.lit(1)), F.lower)
    called = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bprocess(?:es)?\s+(?:named|called)\s+[`'\"]([a-zA-Z0-9_\-\.]+)"), F.lit(1)), F.lower)
    bare = F.array_compact(F.array(*(F.when(_whole(low, (n,)), n) for n in BARE_NAMES)))
    families = F.array_compact(F.array(*(F.when(_whole(low, words), f) for f, words in FAMILY_WORDS.items())))
    families = F.sort_array(F.array_distinct(F.when(_whole(low, PROCESS_WORDS), F.concat(families, F.array(*map(F.lit, PROCESS_FAMILIES)))).otherwise(families)))
    return questions.withColumns({"pid": number(PID), "tid": number(TID), "process_names": F.array_distinct(F.concat(exe, called, bare)), "suspicious": _whole(low, SUSPICIOUS_WORDS), "families": families})


#: The notice that answers on signatures carry, and routes that need it or that answers must decline.
NOTICE, SIGNATURE_ROUTES, DECLINED_ROUTES = "automated corroboration check", ("Q11", "Q12", "Q13", "Q16", "Q18"), ("Q9",)
ABSENCE = ("no evidence of", "there is no", "was not found", "were not found", "did not occur")


def audit_answers(answers: DataFrame) -> DataFrame:
    """answers(question_id, qid, answer, confidence, citations, plugins) with the checks that fail; plugins are those of the question's route."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    declined, cited = low.contains("cannot") | low.contains("out of scope"), F.coalesce(F.size("citations"), F.lit(0)) > 0
    out, signs, absent = F.col("qid").isin(*DECLINED_ROUTES), F.col("qid").isin(*SIGNATURE_ROUTES), low.rlike("|".join(ABSENCE))
    named = F.filter("plugins", lambda p: absent & low.contains(F.concat(F.lit("no evidence of "), F.element_at(F.split(p, r"\."), -1))))
    checks = F.array_compact(
        F.array(
            F.when(F.col("confidence").isNull(), "no confidence value").when(F.col("confidence") >= 100, "confidence not below 100"),
            F.when(out & ~declined, "out-of-scope question did not decline").when(~out & ~cited, "no citations"),
            F.when(signs & ~low.contains(NOTICE), "signature answer missing corroboration notice"),
        )
    )
    return answers.withColumn("failures", F.concat(checks, F.coalesce(F.transform(named, lambda p: F.concat(F.lit("asserts absence via unsearched "), p)), F.array().cast("array<string>"))))


def pass_rate(audited: DataFrame) -> DataFrame:
    return audited.agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.size("failures") == 0).alias("passed"))
