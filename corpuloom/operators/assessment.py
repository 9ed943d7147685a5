"""Assessment of question and answer pairs: reasons against them, a quality score, and complexity, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuloom.functions import text as X

# Patterns, phrases and thresholds of the published scoring, in its order.
PERSONAL = r"\b(i|i'm|i've|i'd|me|my|mine|we|our|husband|wife|partner|son|daughter|mother|father|sister|brother|child|baby|infant)\b"
TEMPORAL = r"\b(ago|since|recently|previously|formerly|history of|used to|for the past|recurrent|recurring|again|last (?:week|month|year)|\d+\s*(?:days?|weeks?|months?|years?)\b)"
PREFERENCE = r"\b(prefer|preference|avoid|cannot|can't|unable|don't want|do not want|allergic|allergy|vegetarian|vegan|religious|cost|afford|available|concerned about)\b"
SIGNALS = {
    "health_seed": {
        "personal_entity": PERSONAL,
        "temporal_history": TEMPORAL,
        "condition_history": r"\b(diagnosed|diagnosis|history of|suffer(?:ing|ed)? from|chronic|condition|disease|disorder|syndrome|previous episode|past episode)\b",
        "treatment": r"\b(take|takes|taking|taken|prescribed|prescription|medication|medicine|tablet|capsule|pill|dose|dosage|surgery|therapy|treatment|insulin|metformin|antibiotic|injection|physiotherapy)\b",
        "measurement": r"(?:\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|kg|mmol/l|mmol|mmhg|bpm|cm|mm|%|degrees?)\b)|\b(test|result|scan|x-ray|mri|ct|ultrasound|blood pressure|glucose|hba1c|cholesterol|level)\b",
        "event_exposure": r"\b(after|before|ate|eaten|eating|drank|drinking|travel(?:led|ed)?|injury|injured|fell|fall|contact|exposed|exposure|accident|bitten|stung)\b",
        "preference_constraint": PREFERENCE,
        "symptom_course": r"\b(started|began|worsen(?:ed|ing|s)?|improv(?:ed|ing|es)?|persistent|persisting|constant|intermittent|comes and goes|returned|resolved|relieved|risen|increased|decreased|progressive)\b",
    },
    "general": {
        "personal_entity": PERSONAL,
        "temporal_history": TEMPORAL,
        "preference_constraint": PREFERENCE,
        "goal_plan": r"\b(my goal|i am planning|i'm planning|i plan to|i need to|i have to|i am trying|i'm trying|working toward|deadline|upcoming|next week|next month)\b",
        "experience_history": r"\b(i tried|i have tried|i've tried|previous attempt|in the past|my experience|i learned|i have been|i've been|recently|last time|used to)\b",
        "resource_constraint": r"\b(my budget|within budget|cannot afford|can't afford|limited time|only have|available to me|my schedule|work schedule|live in|located in|access to|without access)\b",
        "relationship_context": r"\b(my partner|my spouse|my friend|my family|my child|my manager|my colleague|my team|our household|our relationship)\b",
    },
    "coding": {
        "project_environment": r"\b(project|repository|repo|codebase|application|service|runtime|operating system|linux|windows|macos)\b",
        "language_version": r"\b(python|javascript|typescript|java|c\+\+|c#|rust|go|ruby|php|swift|kotlin|node(?:\.js)?)(?:\s*(?:version\s*)?\d+(?:\.\d+)*)?\b",
        "dependency_framework": r"\b(library|package|dependency|framework|sdk|django|flask|fastapi|react|vue|angular|spring|pandas|numpy|pytest|express)\b",
        "interface_contract": r"\b(function signature|method signature|input|output|return type|schema|endpoint|api|interface|class|method|function|parameter|argument)\b",
        "failure_history": r"\b(error|exception|traceback|failing|failed|does not work|doesn't work|bug|incorrect|previous attempt|tried|currently returns)\b",
        "implementation_constraint": r"\b(must|must not|cannot|can't|without using|do not use|don't use|required|constraint|time complexity|space complexity|thread-safe|backward compatible)\b",
        "style_preference": r"\b(prefer|style|type hints|docstring|format|naming convention|functional style|object-oriented)\b",
        "deployment_context": r"\b(docker|kubernetes|lambda|aws|azure|gcp|deployment|production|ci/cd|github actions|container)\b",
    },
}
BOILERPLATE = (
    r"hello(?: and welcome)?",
    r"thank you for (?:your|the) query",
    r"thanks for (?:your|the) query",
    r"hope (?:this|it) (?:helps|has helped you)",
    r"please (?:do not hesitate to )?contact (?:us|me) again",
    r"if you have (?:any |another )?(?:further )?(?:query|queries|questions?)",
    r"let me know if i can assist you further",
    r"thanks for choosing (?:our service|health care magic)",
    r"welcome to (?:ask a doctor|health care magic)(?: service)?",
    r"wishing you (?:an )?(?:early|speedy)? ?recovery",
    r"regards",
    r"take care",
)
SENTENCE, RELATION = r"[.!?]+", r"\b(after|before|because|since|when|while|but|however|although|then|despite|unless|if)\b"
SUBSTANCE = r"\b(advise|recommend|should|need|because|suggest|likely|may|consider|review|evaluate|test|discuss|monitor|diagnos|treat|avoid|continue|seek|consult|refer|implement|return|create|explain|use|write|fix|validate|handle|configure)\w*\b"
INTENT = (
    r"(?:^|[.!]\s+)(?:what|why|how|when|where|which|who|can|could|should|would|is|are|do|does|did|will)\b|"
    r"(?:^|[.!]\s+)(?:implement|write|create|build|fix|explain|design|provide|generate|refactor|debug|convert|complete|develop)\b|"
    r"\b(?:what should i|is it|do i|can i|could you|would you|any advice|need advice|want to know|"
    r"suggest (?:a )?remedy|please (?:advise|help|tell|suggest|recommend)|kindly (?:advise|help|tell)|reason for|cause of)\b"
)
INSTRUCTION = (
    r"\b(?:you are (?:tasked with|asked to)|your task is to|you need to|the goal is to|please)\b[\s\S]{0,240}"
    r"\b(?:implement|writ|creat|build|fix|explain|design|provid|generat|refactor|debug|convert|complet|develop|modif|updat|optimiz)\w*\b"
)
CODE_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\s\p{L}\p{N}_]"
LIMITS = {"question_chars": (40, 2500), "answer_chars": (50, 6000), "question_tokens": 8, "answer_tokens": 8, "english": 0.75, "boilerplate": 0.65, "score": 65}
MOST_PUNCTUATION, MOST_PUNCTUATION_CODE, LEAST_CONTAINED, WIDTH = 0.18, 0.45, 0.8, 10
#: Patterns whatever the case; word boundaries are those of all of Unicode.
ANY_CASE = "(?iU)"
FAMILY_POINTS = (0, 20, 30, 35, 40)
LENGTH_POINTS = ((80, 20), (40, 15), (20, 10), (8, 5))


def boilerplate(c: Column) -> Column:
    """A text without its stock phrases."""
    for p in BOILERPLATE:
        c = F.regexp_replace(c, f"(?i){p}", " ")
    return c


def sentences(c: Column) -> Column:
    """Parts between sentence ends that hold more than white space; one at least."""
    return F.greatest(F.lit(1), F.size(F.filter(F.split(c, SENTENCE), lambda x: x.rlike(r"\S"))))


def families(c: Column, domain: Column) -> Column:
    """Names of the domain's signals in a text, in order; any other domain counts as health."""
    own = {k: X.signal_families(c, v) for k, v in SIGNALS.items()}
    return F.when(domain == "general", own["general"]).when(domain == "coding", own["coding"]).otherwise(own["health_seed"])


def code_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(CODE_TOKEN), 0)


def contained(question: Column, answer: Column, n: int = WIDTH) -> Column:
    """Share of the answer's distinct runs of n code tokens that the question holds, both given as columns of tokens; 0 for shorter answers.

    An expression would be computed again for each run, so tokens have to be in columns.
    """
    return X.directed_overlap(X.grams(question, n), X.grams(answer, n))


def complexity_points(n_families: Column, tokens: Column, n_sentences: Column, relations: Column) -> Column:
    over = lambda c, n: (c >= n).cast("int")
    return F.least(n_families, F.lit(6)) + over(tokens, 50) + over(tokens, 100) + over(n_sentences, 3) + over(relations, 2)


def _once(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed before what follows, which would otherwise repeat its patterns for each use."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("row_")).select("row_.*")


def assess(df: DataFrame) -> DataFrame:
    """id, reasons, quality_score, its four components, families, complexity and its points, status.

    df: id, source_dataset, domain, raw_question, answer. Null texts count as empty.
    """
    q, a = F.trim(F.coalesce("raw_question", F.lit(""))), F.trim(F.coalesce("answer", F.lit("")))
    f = _once(df.select("id", "source_dataset", "domain", q.alias("q"), a.alias("a")))
    f = f.withColumns({
        "qt": F.size(X.tokens(F.col("q"))), "at": F.size(X.tokens(F.col("a"))), "content": F.size(X.tokens(boilerplate(F.col("a")))), "qs": sentences(F.col("q")), "as": sentences(F.col("a")),
        "relations": F.regexp_count("q", F.lit(f"{ANY_CASE}{RELATION}")), "families": families(F.col("q"), F.col("domain")), "q_english": X.english_ratio(F.col("q")), "a_english": X.english_ratio(F.col("a")),
        "asks": F.col("q").contains("?") | F.col("q").rlike(f"{ANY_CASE}{INTENT}") | ((F.col("domain") == "coding") & F.col("q").rlike(f"{ANY_CASE}{INSTRUCTION}")),
    })
    f = _once(f)
    most = F.when(F.col("domain") == "coding", MOST_PUNCTUATION_CODE).otherwise(MOST_PUNCTUATION)
    f = f.withColumn("stock", F.when(F.col("at") > 0, F.greatest(F.lit(0.0), 1 - F.col("content") / F.col("at"))).otherwise(1.0)).withColumn("noise", X.noisy(F.col("q"), most) | X.noisy(F.col("a"), most))
    coding = F.col("domain") == "coding"
    f = _once(f.withColumns({"q_code": F.when(coding, code_tokens(F.col("q"))), "a_code": F.when(coding, code_tokens(F.col("a")))}))
    f = _once(f.withColumn("contained", F.when(coding, contained(F.col("q_code"), F.col("a_code")))).drop("q_code", "a_code")).withColumn("n_families", F.size("families"))
    size = lambda c: F.length(c)
    (q_lo, q_hi), (a_lo, a_hi) = LIMITS["question_chars"], LIMITS["answer_chars"]
    rules = {
        "missing_id": F.col("id").isNull() | (F.trim(F.col("id").cast("string")) == ""), "missing_source_dataset": F.coalesce(F.trim("source_dataset"), F.lit("")) == "", "missing_raw_question": F.col("q") == "",
        "missing_source_answer": F.col("a") == "", "question_too_short": size("q") < q_lo, "question_too_long": size("q") > q_hi, "answer_too_short": size("a") < a_lo, "answer_too_long": size("a") > a_hi,
        "question_too_few_tokens": F.col("qt") < LIMITS["question_tokens"], "answer_too_few_tokens": F.col("at") < LIMITS["answer_tokens"],
        "question_language_mismatch": F.col("q_english") < LIMITS["english"], "answer_language_mismatch": F.col("a_english") < LIMITS["english"],
        "answer_boilerplate_dominated": F.col("stock") > LIMITS["boilerplate"], "text_noise": F.col("noise"), "no_memory_signal": F.col("n_families") == 0, "missing_question_intent": ~F.col("asks"),
        "reference_answer_in_question": F.col("contained") >= LEAST_CONTAINED,
    }
    one = lambda c, points: F.when(c, points).otherwise(0)
    steps = None
    for least, points in LENGTH_POINTS:
        steps = F.when(F.col("content") >= least, points) if steps is None else steps.when(F.col("content") >= least, points)
    parts = {
        "question_informativeness": F.least(F.lit(25), F.bround(15 * F.least("qt", F.lit(80)) / 80).cast("int") + one(F.col("qs") >= 2, 5) + one(F.col("relations") >= 2, 5)),
        "answer_substance": F.least(F.lit(25), steps.otherwise(0) + one(F.col("a").rlike(f"{ANY_CASE}{SUBSTANCE}"), 5) + one(F.col("as") >= 2, 5)),
        "memory_suitability": F.element_at(F.array(*map(F.lit, FAMILY_POINTS)), F.least(F.col("n_families") + 1, F.lit(len(FAMILY_POINTS)))),
        "cleanliness_coherence": one((F.col("q_english") >= 0.9) & (F.col("a_english") >= 0.9), 4) + one(F.col("stock") <= 0.25, 3) + one(~F.col("noise"), 3),
    }
    points = complexity_points(F.col("n_families"), F.col("qt"), F.col("qs"), F.col("relations"))
    f = f.withColumns({**parts, "reasons": F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()])), "complexity_points": points})
    f = _once(f)
    score = F.least(F.lit(100), sum((F.col(k) for k in parts), F.lit(0)))
    f = f.withColumn("quality_score", score).withColumn("complexity", F.when(F.col("complexity_points") <= 3, "simple").when(F.col("complexity_points") <= 6, "medium").otherwise("complex"))
    status = F.when(F.size("reasons") > 0, "rejected_hard_filter").when(F.col("quality_score") < LIMITS["score"], "rejected_quality_score").otherwise("eligible")
    return f.select("id", "domain", "reasons", *parts, "quality_score", "families", "complexity_points", "complexity", status.alias("status"))


def overlap_similarity(a: Column, b: Column, stop: tuple[str, ...] = ()) -> Column:
    """1 where one normalised text holds the other, else the Jaccard similarity of their units: words of three characters or more, or pairs of characters in texts with Chinese; 0 for empty texts."""

    def norm(c):
        c = F.lower(X.normalise(F.coalesce(c, F.lit(""))))
        c = F.regexp_replace(c, r"[^\p{L}\p{N}_]+", " ")
        for w in stop:
            c = F.replace(F.regexp_replace(c, rf"(?U)\b{w}\b", " "), F.lit(w), F.lit(" "))
        return X.normalise(c)

    def units(c):
        packed = F.replace(c, F.lit(" "), F.lit(""))
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(packed) - 1)), lambda i: F.substring(packed, i, 2))
        return F.array_distinct(F.when(X.contains_cjk(c), pairs).otherwise(F.filter(F.split(c, " "), lambda x: F.length(x) > 2)))

    x, y = norm(a), norm(b)
    return F.when((x == "") | (y == ""), 0.0).when(x.contains(y) | y.contains(x), 1.0).otherwise(X.jaccard(units(x), units(y)))
