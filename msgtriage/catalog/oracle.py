"""The queries in SQL, written independently of the DataFrame code."""

from __future__ import annotations

import re

SPACES = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
LONG = rf"{W}{{2,}}"
HYPHEN = rf"{W}[\p{{L}}\p{{N}}_-]*{W}"
STOP = ("'the','of','and','to','in','a','is','that','der','die','und','le','la','de','des','que','el'")


def collapse(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '[{SPACES}]+', ' ', 'g'))"


def trim_ends(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def has(c: str, *needles: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{n}')" for n in needles) + ")"


def has_word(c: str, *words: str) -> str:
    return f"regexp_matches(' ' || coalesce({c}, '') || ' ', '{NW}(?:{'|'.join(words)}){NW}')"


def apostrophes(c: str) -> str:
    return f"translate({c}, '’' || chr(146), '''''')"


def repair(c: str) -> str:
    return f"replace({apostrophes(trim_ends(c))}, '  ', ' ')"


def lexicon(lower: str, entries: dict[str, tuple[str, ...]]) -> str:
    whens = " ".join(f"WHEN {has(lower, *kws)} THEN '{label}'" for label, kws in entries.items())
    return f"CASE {whens} END"


LEXICON = {
    "en": (" the ", " of ", " and "), "de": (" der ", " und ", " die "),
    "fr": (" le ", " des ", " et "), "es": (" de la ", " que ", " el ", " los "),
}
LEXICON_2 = {
    "en": (" that ", " with ", " this "), "de": (" ein", " das "),
    "fr": (" les ", " est "), "es": (" los ", " por "),
}

# --- the tables in their parts ----------------------------------------------

MESSAGES = """messages AS (
  SELECT conv_id * 4294967296 + turn AS tweet_id,
         CASE WHEN role = 'assistant' THEN 'brand' ELSE role || conv_id::VARCHAR END AS author_id,
         role = 'user' AS inbound, text,
         CASE WHEN turn > 0 THEN conv_id * 4294967296 + turn - 1 END AS in_response_to_tweet_id
  FROM conversations)"""
DOCS = "docs AS (SELECT doc_id AS id, text AS customer_text, lang, source FROM documents)"
TURNS = f"{MESSAGES}, turns AS (SELECT tweet_id AS id, text AS customer_text FROM messages WHERE inbound)"
GOLD = f"""{DOCS}, gold AS (
  SELECT id, customer_text, lang AS intent, toxic = 1 AS should_escalate,
         CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS escalation_reason,
         source AS difficulty_stratum, substring(customer_text, 1, 280) AS reference_resolution
  FROM docs JOIN labels ON id = doc_id)"""
SEEDS = """seeds AS (
  SELECT * REPLACE (row_number() OVER (ORDER BY id) AS id) FROM gold WHERE should_escalate)"""


def pairs_cte(relevant: bool) -> str:
    keep = "WHERE author_id = 'brand' OR contains(lower(text), 'the')" if relevant else ""
    return f"""{MESSAGES}, relevant AS (SELECT * FROM messages {keep}),
pairs AS (
  SELECT p.tweet_id AS inquiry_id, r.tweet_id AS response_id,
         {collapse('p.text')} AS customer_text, {collapse('r.text')} AS agent_text
  FROM relevant r JOIN relevant p ON r.in_response_to_tweet_id = p.tweet_id
  WHERE r.author_id = 'brand' AND NOT r.inbound AND p.inbound
    AND length({collapse('p.text')}) >= 15 AND length({collapse('r.text')}) >= 15)"""


CORPUS = f"""{pairs_cte(False)}, corpus AS (
  SELECT inquiry_id, response_id, customer_text, agent_text FROM pairs
  QUALIFY row_number() OVER (PARTITION BY customer_text ORDER BY response_id) = 1)"""
KEPT = f"""{GOLD}, kept AS (
  SELECT id, customer_text FROM docs
  WHERE {trim_ends('customer_text')} NOT IN (SELECT {trim_ends('customer_text')} FROM gold))"""
WEAK = f"""weak AS (
  SELECT * FROM (SELECT id, customer_text, {lexicon('lower(customer_text)', LEXICON)} AS intent FROM kept
                 WHERE length(customer_text) > 20) WHERE intent IS NOT NULL)"""
LABELLED = f"""{DOCS}, labelled AS (
  SELECT id, lang AS truth, coalesce({lexicon('lower(customer_text)', LEXICON)}, 'none') AS predicted
  FROM docs)"""
CLASSES = f"""{LABELLED}, sides AS (
  SELECT truth AS label, 1 AS actual, 0 AS given, (truth = predicted)::INT AS tp FROM labelled
  UNION ALL SELECT predicted, 0, 1, 0 FROM labelled),
rates AS (
  SELECT label, sum(actual)::BIGINT AS support,
         CASE WHEN sum(given) > 0 THEN sum(tp) / sum(given) ELSE 0 END AS p,
         CASE WHEN sum(actual) > 0 THEN sum(tp) / sum(actual) ELSE 0 END AS r
  FROM sides GROUP BY label),
classes AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM rates)"""


# --- TF-IDF --------------------------------------------------------------------

def grams_sql(source: str, key: str, text: str, pattern: str, high: int, stop: str, name: str) -> str:
    """CTEs that list every n-gram occurrence of a table."""
    kept = f"list_filter(t0, lambda w: w NOT IN ({stop}))" if stop else "t0"
    parts = ["t"] + [
        f"CASE WHEN len(t) >= {n} THEN list_transform(range(1, len(t) - {n} + 2), "
        f"lambda i: array_to_string(t[i:i + {n} - 1], ' ')) ELSE [] END" for n in range(2, high + 1)
    ]
    return f"""{name}_tokens AS (
  SELECT {key}, {kept} AS t FROM (
    SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '{pattern}') AS t0 FROM {source})),
{name}_terms AS (SELECT {key}, unnest(flatten([{', '.join(parts)}])) AS term FROM {name}_tokens),
{name}_tf AS (SELECT {key}, term, count(*) AS tf FROM {name}_terms GROUP BY ALL)"""


def vocabulary_sql(name: str, source: str, size: int | None = None) -> str:
    cut = f"ORDER BY cf DESC, term LIMIT {size}" if size else ""
    return f"""voc AS (
  SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM {name}_tf GROUP BY term {cut}),
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM voc, (SELECT count(*) AS n FROM {source}))"""


def weights_sql(name: str, key: str, sublinear: bool) -> str:
    tf = "(1 + ln(tf))" if sublinear else "tf"
    return f"""{name}_raw AS (SELECT {key}, term, {tf} * idf AS w FROM {name}_tf JOIN idf USING (term)),
{name}_w AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {name}_raw)"""


INDEX = f"""{CORPUS}, {grams_sql('corpus', 'inquiry_id', 'customer_text', LONG, 2, STOP, 'd')},
{vocabulary_sql('d', 'corpus')}, {weights_sql('d', 'inquiry_id', True)}"""


def scores_sql(source: str, text: str = "customer_text") -> str:
    return f"""{grams_sql(source, 'id', text, LONG, 2, STOP, 'q')}, {weights_sql('q', 'id', True)},
scores AS (
  SELECT q_w.id, d_w.inquiry_id AS doc_id, round(sum(q_w.weight * d_w.weight), 6) AS score
  FROM q_w JOIN d_w USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM scores)"""


# --- classification, decisions, replies ------------------------------------------

WEIGHTS = {
    "en": {"the": 1.2, "of": 0.9, "and": 0.9, "to": 0.6, "is": 0.5},
    "de": {"der": 1.4, "die": 1.1, "und": 1.1, "den": 0.7, "von": 0.6},
    "fr": {"le": 1.1, "les": 1.3, "des": 1.2, "et": 0.9, "la": 0.3},
    "es": {"el": 1.3, "los": 1.2, "que": 0.6, "y": 0.9, "la": 0.4},
}
BIAS = {"en": 0.3, "de": 0.0, "fr": 0.0, "es": -0.1}
_weight_rows = ", ".join(f"('{l}', '{t}', {w})" for l, ws in WEIGHTS.items() for t, w in ws.items())
_bias_rows = ", ".join(f"('{l}', {b})" for l, b in BIAS.items())


def linear_sql(source: str) -> str:
    return f"""wt(label, term, w) AS (VALUES {_weight_rows}), bias(label, b) AS (VALUES {_bias_rows}),
lin_tokens AS (
  SELECT id, unnest(regexp_extract_all(lower(coalesce(customer_text, '')), '{W}+')) AS term FROM {source}),
lin_sums AS (SELECT id, label, sum(w::DOUBLE) AS s FROM lin_tokens JOIN wt USING (term) GROUP BY ALL),
lin_scores AS (
  SELECT s.id, bias.label, b::DOUBLE + coalesce(lin_sums.s, 0) AS score
  FROM {source} s CROSS JOIN bias LEFT JOIN lin_sums ON lin_sums.id = s.id AND lin_sums.label = bias.label),
lin_exp AS (SELECT *, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM lin_scores),
lin_probs AS (SELECT id, label, score, e / sum(e) OVER (PARTITION BY id) AS probability FROM lin_exp),
lin_best AS (
  SELECT id, label AS intent, probability AS confidence FROM lin_probs
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY probability DESC, label) = 1)"""


FRAGMENT_TEXT = trim_ends(f"regexp_replace(lower({trim_ends('customer_text')}), '^@{W}+[{SPACES}]*', '')")
IS_FRAGMENT = f"""({FRAGMENT_TEXT} IN ('that it.', 'von.', 'osrañ.', 'reorea. nd.', 'erinst resh.')
  AND (CASE WHEN {collapse(FRAGMENT_TEXT)} = '' THEN 0
       ELSE len(string_split({collapse(FRAGMENT_TEXT)}, ' ')) END) <= 2)"""
IS_OUT = has("lower(customer_text)", "***", "###", " | ")
DAMPED = f"""CASE WHEN intent = 'de' AND NOT {has('lower(customer_text)', ' und ', ' den ')}
  THEN confidence * 0.75 ELSE confidence END"""


#: What stands in for a model that was not fitted.
FALLBACK = "lin_best AS (SELECT id, 'en' AS intent, 0.5::DOUBLE AS confidence FROM docs)"


def decided_sql(source: str, labels: str | None = None) -> str:
    low = "lower(customer_text)"
    hazard = has_word(low, "idiot", "moron", "scum")
    threat = has_word(low, "trash", "worthless", "loser", "clown")
    dispute = f"intent = 'fr' AND {has(low, 'eaux', 'ieraux')}"
    store = f"{has(low, 'license')} AND {has(low, ' with ', ' that ', ' mit ', ' les ')}"
    return f"""{labels or linear_sql(source)},
classified AS (
  SELECT id, customer_text,
         CASE WHEN {IS_FRAGMENT} THEN 'fragment' WHEN {IS_OUT} THEN 'out_of_scope' ELSE intent END AS intent,
         CASE WHEN {IS_FRAGMENT} THEN 0.98::DOUBLE WHEN {IS_OUT} THEN 0.95::DOUBLE
              ELSE round({DAMPED}, 4) END AS confidence
  FROM {source} JOIN lin_best USING (id)),
fired AS (
  SELECT *, CASE WHEN {hazard} THEN 'HAZARD' WHEN {threat} THEN 'THREAT' WHEN intent = 'de' THEN 'SENSITIVE'
                 WHEN {dispute} THEN 'DISPUTE' WHEN intent = 'fragment' THEN 'FRAGMENT'
                 WHEN {store} THEN 'STORE' WHEN confidence < 0.6 THEN 'UNCERTAIN' ELSE 'ROUTINE'
            END AS trigger_rule
  FROM classified),
decided AS (
  SELECT *, trigger_rule <> 'ROUTINE' AS should_escalate,
         CASE trigger_rule WHEN 'HAZARD' THEN 'hazard word' WHEN 'THREAT' THEN 'threat word'
              WHEN 'SENSITIVE' THEN 'sensitive intent' WHEN 'DISPUTE' THEN 'disputed intent'
              WHEN 'FRAGMENT' THEN 'fragment' WHEN 'STORE' THEN 'store visit'
              WHEN 'UNCERTAIN' THEN printf('confidence %.2f below 0.60', confidence)
              ELSE 'routine' END AS reason,
         CASE trigger_rule WHEN 'HAZARD' THEN 'CRITICAL' WHEN 'THREAT' THEN 'HIGH' WHEN 'SENSITIVE' THEN 'HIGH'
              WHEN 'DISPUTE' THEN 'MEDIUM' WHEN 'FRAGMENT' THEN 'MEDIUM' WHEN 'STORE' THEN 'MEDIUM'
              ELSE 'LOW' END AS risk_level
  FROM fired)"""


BARE = f"regexp_replace(lower(coalesce(customer_text, '')), '@{W}+', ' ', 'g')"
TOPIC = f"""CASE WHEN {has_word(BARE, 'thble', 'thnd')} THEN 'heat'
  WHEN {has_word(BARE, 'thor', 'erha')} OR {has_word(BARE, 'of the')} THEN 'cable'
  WHEN {has_word(BARE, 'thon', 'eron')} THEN 'battery'
  WHEN {has_word(BARE, 'anea')} OR intent = 'fr' THEN 'backup'
  WHEN intent = 'es' THEN 'feedback' WHEN intent = 'out_of_scope' THEN 'out_of_scope' END"""
TOPIC_REPLY = """CASE topic WHEN 'heat' THEN 'Let it cool down first: settings > power.'
  WHEN 'cable' THEN 'Try another cable, see https://example.com/cable for more.'
  WHEN 'battery' THEN 'Open settings > battery and tell us the figure.'
  WHEN 'backup' THEN 'Open settings > storage to see what fills it.'
  WHEN 'feedback' THEN 'Thank you for telling us.'
  WHEN 'out_of_scope' THEN 'We can only help with our own products.' END"""
HANDOVER = """CASE trigger_rule WHEN 'HAZARD' THEN 'Please stop using it and write to us in a DM; your safety matters most.'
  WHEN 'THREAT' THEN 'A colleague will read this today. Send a DM so that we can reach you.'
  WHEN 'SENSITIVE' THEN 'Accounts are handled at https://example.com/recover and nowhere else.'
  WHEN 'DISPUTE' THEN 'Let us go through this charge together in a DM.'
  WHEN 'FRAGMENT' THEN 'A few more words about it would help us.'
  ELSE 'Write to us directly with the details and we will look into it.' END"""


def sanitize(c: str) -> str:
    no_handles = f"regexp_replace(coalesce({c}, ''), '@\\p{{Nd}}+', '', 'g')"
    linked = f"regexp_replace({no_handles}, 'https?://t\\.co/{W}+', 'https://apple.co/support', 'g')"
    return collapse(apostrophes(linked))


def drafted_sql(best: str) -> str:
    """CTEs from ``decided`` (joined with the best resolution) to replies."""
    return f"""routed AS (SELECT *, {TOPIC} AS topic, {sanitize(best)} AS grounded FROM with_best),
drafted AS (
  SELECT *, substring(CASE WHEN should_escalate THEN {HANDOVER} ELSE coalesce(
      {TOPIC_REPLY}, CASE WHEN length(grounded) BETWEEN 26 AND 275 THEN grounded END,
      'Which version is this about? That will help us find the cause.') END, 1, 280) AS drafted_reply
  FROM routed)"""


def production_sql(source: str) -> str:
    return f"""{INDEX}, {scores_sql(source)}, {decided_sql(source)},
with_best AS (
  SELECT decided.*, coalesce(round(r.score, 4), 0) AS retrieval_score, c.agent_text AS best
  FROM decided LEFT JOIN ranked r ON r.id = decided.id AND r.rank = 1
  LEFT JOIN corpus c ON c.inquiry_id = r.doc_id),
{drafted_sql('best')},
case_lists AS (
  SELECT id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS cases FROM ranked WHERE rank <= 3 GROUP BY id)"""


def simple_sql(source: str) -> str:
    hit = has("lower(customer_text)", "idiot", "trash", "license")
    return f"""simple AS (
  SELECT s.id, s.customer_text, b.intent, b.confidence, coalesce({hit.replace('customer_text', 's.customer_text')}, false) AS should_escalate,
         coalesce(round(r.score, 4), 0) AS retrieval_score,
         substring(coalesce(c.agent_text, 'Send us a DM and we will help.'), 1, 280) AS drafted_reply
  FROM {source} s JOIN lin_best b ON b.id = s.id LEFT JOIN ranked r ON r.id = s.id AND r.rank = 1
  LEFT JOIN corpus c ON c.inquiry_id = r.doc_id)"""


def rubric_columns(markers: dict, text: str, reply: str, escalated: str) -> str:
    """Three scores as SELECT items g, a, t."""
    said, asked = f"lower({reply})", f"lower({text})"
    con, mis = markers["contradiction"], markers["mismatch"]
    return f"""CASE WHEN length({reply}) < 30 THEN 2
     WHEN {escalated} AND {has(said, *markers['handover'])} THEN 5
     WHEN {has(said, *markers['steps'])} THEN
       CASE WHEN contains({asked}, '{con[0]}') AND contains({said}, '{con[1]}') THEN 3 ELSE 5 END
     WHEN contains({asked}, '{mis[0]}') AND contains({said}, '{mis[1]}') THEN 3 ELSE 4 END AS g,
CASE WHEN {has(said, *markers['actionable'])} THEN 5 WHEN {has(said, *markers['canned'])} THEN 2 ELSE 4 END AS a,
CASE WHEN length({reply}) > 280 THEN 2 ELSE 5 END AS t"""


MARKERS = {
    "handover": ("dm", "safety"), "steps": ("settings >", "example.com", "restart"),
    "contradiction": ("and the", "settings"), "mismatch": ("that", "help"),
    "actionable": ("settings >", "dm", "https://"), "canned": ("thank you for telling",),
}
PAIR_MARKERS = {
    "handover": ("ththe", "eaux"), "steps": ("ndthe", "ung der", "les de"),
    "contradiction": (" of ", " to "), "mismatch": (" in ", "inth"),
    "actionable": ("erthe", "ungge"), "canned": ("onthe", "ement de"),
}
RATED = f"""{pairs_cte(False)}, flagged AS (
  SELECT *, {has('lower(customer_text)', ' is ', ' que ', ' die ')} AS should_escalate FROM pairs),
rated AS (
  SELECT response_id, should_escalate,
         {rubric_columns(PAIR_MARKERS, 'customer_text', 'agent_text', 'should_escalate')} FROM flagged),
scored AS (SELECT *, round((g + a + t) / 3.0::DOUBLE, 2) AS o FROM rated)"""

GOLD_MESSAGES = f"{GOLD}, asked AS (SELECT id, customer_text FROM gold)"
DETAILED = f"""{GOLD_MESSAGES}, {production_sql('asked')},
prod_rated AS (SELECT *, {rubric_columns(MARKERS, 'customer_text', 'drafted_reply', 'should_escalate')} FROM drafted),
detailed AS (
  SELECT gold.id, gold.customer_text, gold.difficulty_stratum, gold.intent AS gold_intent,
         p.intent AS predicted_intent, gold.intent = p.intent AS intent_match,
         gold.should_escalate AS gold_escalate, p.should_escalate AS predicted_escalate,
         gold.should_escalate = p.should_escalate AS escalation_match,
         gold.escalation_reason AS gold_escalation_reason, p.reason AS agent_escalation_reason,
         p.risk_level, p.trigger_rule, p.drafted_reply, g AS groundedness, a AS actionability,
         t AS brand_tone, round((g + a + t) / 3.0::DOUBLE, 2) AS judge_overall
  FROM gold JOIN prod_rated p USING (id))"""
_TRIVIAL_REPLY = "'Noted. Tell us the version in a DM.'"
ALL_SYSTEMS = f"""{DETAILED}, {simple_sql('asked')},
answers AS (
  SELECT 'trivial' AS system, id, customer_text, 'en' AS intent, false AS should_escalate,
         {_TRIVIAL_REPLY} AS drafted_reply FROM asked
  UNION ALL SELECT 'simple', id, customer_text, intent, should_escalate, drafted_reply FROM simple
  UNION ALL SELECT 'production', id, customer_text, intent, should_escalate, drafted_reply FROM drafted),
judged AS (
  SELECT *, round((g + a + t) / 3.0::DOUBLE, 2) AS o FROM (
    SELECT *, {rubric_columns(MARKERS, 'customer_text', 'drafted_reply', 'should_escalate')} FROM answers)),
predictions AS (
  SELECT j.*, gold.intent AS gold_intent, gold.should_escalate AS gold_escalate
  FROM judged j JOIN gold USING (id)),
esc AS (
  SELECT system, count(*) FILTER (gold_escalate AND should_escalate) AS tp,
         count(*) FILTER (NOT gold_escalate AND should_escalate) AS fp,
         count(*) FILTER (gold_escalate AND NOT should_escalate) AS fn,
         count(*) FILTER (NOT gold_escalate AND NOT should_escalate) AS tn FROM predictions GROUP BY system),
esc_rates AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r,
         CASE WHEN tp + fn > 0 THEN fn / (tp + fn) ELSE 0 END AS far FROM esc)"""

DRAFTS = f"""{MESSAGES}, drafts AS (
  SELECT a.tweet_id AS id, a.text AS reference, b.text AS hypothesis
  FROM messages a JOIN messages b ON b.tweet_id = a.tweet_id + 2
  WHERE a.author_id = 'brand' AND b.author_id = 'brand')"""
DRAFT_TOKENS = f"""{DRAFTS}, toks AS (
  SELECT id, regexp_extract_all(lower(reference), '{W}+') AS r,
         regexp_extract_all(lower(hypothesis), '{W}+') AS h FROM drafts)"""
BLEU = f"""sizes(n) AS (VALUES (1), (2), (3), (4)),
r_grams AS (
  SELECT id, n, gram, count(*) AS k FROM (
    SELECT id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS gram
    FROM toks, sizes) GROUP BY ALL),
h_grams AS (
  SELECT id, n, gram, count(*) AS k FROM (
    SELECT id, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS gram
    FROM toks, sizes) GROUP BY ALL),
hits AS (
  SELECT id, n, sum(least(h_grams.k, coalesce(r_grams.k, 0))) AS hit, sum(h_grams.k) AS total
  FROM h_grams LEFT JOIN r_grams USING (id, n, gram) GROUP BY id, n),
logs AS (
  SELECT toks.id, len(r) AS lr, len(h) AS lh,
         sum(CASE WHEN hit > 0 THEN ln(hit / total) ELSE ln(0.0001::DOUBLE) END) / 4 AS m
  FROM toks CROSS JOIN sizes LEFT JOIN hits ON hits.id = toks.id AND hits.n = sizes.n GROUP BY ALL),
bleus AS (
  SELECT id, CASE WHEN lh = 0 THEN 0 ELSE exp(m + CASE WHEN lh > lr THEN 0 ELSE 1 - lr / lh END) END AS b
  FROM logs)"""
# One step per reference token: the row of the LCS table as a running maximum.
ROUGE = """matches AS (
  SELECT x.id, x.i, y.j FROM
    (SELECT id, unnest(r) AS tok, generate_subscripts(r, 1) AS i FROM toks) x JOIN
    (SELECT id, unnest(h) AS tok, generate_subscripts(h, 1) AS j FROM toks) y ON x.id = y.id AND x.tok = y.tok),
walk(id, stop, i, j, v) AS (
  SELECT id, stop, 0, j, 0 FROM (SELECT id, len(r) AS stop, unnest(range(1, len(h) + 1)) AS j FROM toks)
  UNION ALL
  SELECT id, stop, i, j, max(c) OVER (PARTITION BY id ORDER BY j) FROM (
    SELECT w.id, w.stop, w.i + 1 AS i, w.j,
           greatest(w.v, CASE WHEN m.j IS NOT NULL
             THEN coalesce(lag(w.v) OVER (PARTITION BY w.id ORDER BY w.j), 0) + 1 ELSE 0 END) AS c
    FROM walk w LEFT JOIN matches m ON m.id = w.id AND m.i = w.i + 1 AND m.j = w.j WHERE w.i < w.stop)),
lcs AS (SELECT w.id, max(v) AS l FROM walk w GROUP BY w.id),
rouges AS (
  SELECT toks.id, CASE WHEN coalesce(l, 0) = 0 THEN 0 ELSE
    2 * (l / len(h)) * (l / len(r)) / (l / len(h) + l / len(r)) END AS f
  FROM toks LEFT JOIN lcs USING (id))"""
COSINE = f"""side_tf AS (
  SELECT id, side, term, count(*) AS tf FROM (
    SELECT id, 'r' AS side, unnest(regexp_extract_all(lower(reference), '{LONG}')) AS term FROM drafts
    UNION ALL SELECT id, 'h', unnest(regexp_extract_all(lower(hypothesis), '{LONG}')) FROM drafts) GROUP BY ALL),
side_idf AS (
  SELECT term, ln((1 + 2 * n) / (1 + count(*))) + 1 AS idf
  FROM side_tf, (SELECT count(*) AS n FROM drafts) GROUP BY term, n),
side_w AS (SELECT id, side, term, tf * idf AS w FROM side_tf JOIN side_idf USING (term)),
norms AS (SELECT id, side, sqrt(sum(w * w)) AS norm FROM side_w GROUP BY ALL),
dots AS (
  SELECT a.id, sum(a.w * b.w) AS dot FROM side_w a JOIN side_w b ON a.id = b.id AND a.term = b.term
  WHERE a.side = 'r' AND b.side = 'h' GROUP BY a.id),
cosines AS (
  SELECT drafts.id, coalesce(dot / (nr.norm * nh.norm), 0) AS c FROM drafts
  LEFT JOIN dots ON dots.id = drafts.id
  LEFT JOIN norms nr ON nr.id = drafts.id AND nr.side = 'r'
  LEFT JOIN norms nh ON nh.id = drafts.id AND nh.side = 'h')"""
_LEXICAL_TABLES = (
    "drafts", "toks", "sizes", "r_grams", "h_grams", "hits", "logs", "bleus", "matches", "walk", "lcs", "rouges",
    "side_tf", "side_idf", "side_w", "norms", "dots", "cosines")


def lexical_of(system: str) -> str:
    """The lexical tables of one system, with its name at the end of theirs."""
    tokens = DRAFT_TOKENS[DRAFT_TOKENS.index("toks AS"):]
    tables = f"""drafts AS (
  SELECT id, reference_resolution AS reference, drafted_reply AS hypothesis
  FROM gold JOIN answers USING (id) WHERE system = '{system}'), {tokens}, {BLEU}, {ROUGE}, {COSINE}"""
    return re.sub(rf"\b({'|'.join(_LEXICAL_TABLES)})\b", rf"\1_{system}", tables)


def lexical_rows(system: str) -> str:
    return " ".join(
        f"UNION ALL SELECT '{system}', 'lexical', '{metric}', round(avg({column}), 4) FROM {name}_{system}"
        for metric, column, name in (("bleu_4", "b", "bleus"), ("rouge_l", "f", "rouges"), ("cosine_similarity", "c", "cosines")))


SYSTEMS = ("trivial", "simple", "production")
ALL_METRICS = f"""{ALL_SYSTEMS}, {', '.join(map(lexical_of, SYSTEMS))},
cls AS (
  SELECT system, label, sum(actual) AS actual, sum(given) AS given, sum(hit) AS hit FROM (
    SELECT system, gold_intent AS label, 1 AS actual, 0 AS given, (gold_intent = intent)::INT AS hit FROM predictions
    UNION ALL SELECT system, intent, 0, 1, 0 FROM predictions) GROUP BY ALL),
cls_rates AS (SELECT system, coalesce(hit / nullif(given, 0), 0) AS p, coalesce(hit / nullif(actual, 0), 0) AS r FROM cls),
long AS (
  SELECT system, 'intent' AS metric_group, 'accuracy' AS metric, round(avg((gold_intent = intent)::INT), 4) AS value
  FROM predictions GROUP BY system
  UNION ALL SELECT system, 'intent', 'macro_precision', round(avg(p), 4) FROM cls_rates GROUP BY system
  UNION ALL SELECT system, 'intent', 'macro_recall', round(avg(r), 4) FROM cls_rates GROUP BY system
  UNION ALL SELECT system, 'intent', 'macro_f1',
    round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 4) FROM cls_rates GROUP BY system
  UNION ALL SELECT system, 'escalation', 'precision', round(p, 4) FROM esc_rates
  UNION ALL SELECT system, 'escalation', 'recall', round(r, 4) FROM esc_rates
  UNION ALL SELECT system, 'escalation', 'f1', round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) FROM esc_rates
  UNION ALL SELECT system, 'escalation', 'false_auto_handle_rate', round(far, 4) FROM esc_rates
  UNION ALL SELECT system, 'escalation', 'tp', tp FROM esc_rates
  UNION ALL SELECT system, 'escalation', 'fp', fp FROM esc_rates
  UNION ALL SELECT system, 'escalation', 'fn', fn FROM esc_rates
  UNION ALL SELECT system, 'escalation', 'tn', tn FROM esc_rates
  UNION ALL SELECT system, 'rubric', 'groundedness', round(avg(g), 2) FROM predictions GROUP BY system
  UNION ALL SELECT system, 'rubric', 'actionability', round(avg(a), 2) FROM predictions GROUP BY system
  UNION ALL SELECT system, 'rubric', 'brand_tone', round(avg(t), 2) FROM predictions GROUP BY system
  UNION ALL SELECT system, 'rubric', 'judge_overall', round(avg(o), 2) FROM predictions GROUP BY system
  {' '.join(map(lexical_rows, SYSTEMS))})"""
RATINGS = """ratings AS (
  SELECT o_orderstatus AS dimension, left(o_orderpriority, 1)::INT AS a,
         least(floor(o_totalprice / 100000) + 1, 5)::INT AS b FROM orders)"""
RATES = f"""{RATINGS}, rates AS (
  SELECT dimension, 100.0::DOUBLE * avg((a = b)::INT) AS exact, 100.0::DOUBLE * avg((abs(a - b) <= 1)::INT) AS adjacent,
         avg(b - a) AS bias, count(*) AS n FROM ratings GROUP BY dimension)"""
# Every cell of the rating square, as the definition has it.
KAPPA = """scale AS (
  SELECT dimension, rating, dense_rank() OVER (PARTITION BY dimension ORDER BY rating) AS pos FROM (
    SELECT dimension, a AS rating FROM ratings UNION SELECT dimension, b FROM ratings)),
cells AS (SELECT dimension, a, b, count(*) AS o FROM ratings GROUP BY ALL),
ra AS (SELECT dimension, a, count(*) AS r FROM ratings GROUP BY ALL),
cb AS (SELECT dimension, b, count(*) AS c FROM ratings GROUP BY ALL),
tot AS (SELECT dimension, count(*) AS n FROM ratings GROUP BY dimension),
square AS (
  SELECT x.dimension, (x.pos - y.pos) ** 2 AS w, coalesce(o, 0) AS o, coalesce(r, 0) * coalesce(c, 0) / n AS e
  FROM scale x JOIN scale y ON x.dimension = y.dimension JOIN tot ON tot.dimension = x.dimension
  LEFT JOIN cells ON cells.dimension = x.dimension AND cells.a = x.rating AND cells.b = y.rating
  LEFT JOIN ra ON ra.dimension = x.dimension AND ra.a = x.rating
  LEFT JOIN cb ON cb.dimension = x.dimension AND cb.b = y.rating),
kappas AS (SELECT dimension, 1 - sum(w * o) / nullif(sum(w * e), 0) AS k FROM square GROUP BY dimension)"""
CANDIDATES = f"""{TURNS}, repaired AS (SELECT id, {repair('customer_text')} AS customer_text FROM turns),
candidates AS (
  SELECT * FROM (
    SELECT id, customer_text, {lexicon('lower(customer_text)', LEXICON_2)} AS intent FROM repaired
    WHERE length(customer_text) BETWEEN 20 AND 260) WHERE intent IS NOT NULL)"""
QUOTAS = "quotas(intent, target) AS (VALUES ('en', 40), ('de', 25), ('fr', 30), ('es', 12))"
ROOM = f"""{QUOTAS}, used AS (SELECT intent, count(*) AS used FROM seeds GROUP BY intent),
room AS (SELECT intent, coalesce(target, 20) - coalesce(used, 0) AS room FROM quotas FULL JOIN used USING (intent))"""


def stratum_columns(text: str) -> str:
    low = f"lower({text})"
    return f"""CASE WHEN intent IN ('de', 'es') THEN 'account' WHEN {has(low, 'erst', 'eaux', 'hate')} THEN 'hostile'
  WHEN {has(low, ' and ', ' et ')} THEN 'several' ELSE 'routine' END AS difficulty_stratum,
CASE WHEN intent IN ('de', 'es') THEN 'policy' WHEN {has(low, 'erst', 'eaux', 'hate')} THEN 'agitated'
  WHEN {has(low, ' and ', ' et ')} THEN 'several issues' ELSE 'routine' END AS escalation_reason,
intent IN ('de', 'es') OR {has(low, 'erst', 'eaux', 'hate')} AS should_escalate"""


DECIDED = f"WITH {DOCS}, {decided_sql('docs')}"
FULL = "id, intent, confidence, should_escalate, reason, risk_level, trigger_rule, drafted_reply"

ORACLES: dict[str, str] = {
    "scan_messages": f"WITH {MESSAGES} SELECT * FROM messages",
    "scan_pairs": f"WITH {CORPUS} SELECT * FROM corpus",
    "relevance_filter": f"WITH {MESSAGES} SELECT tweet_id, author_id FROM messages "
                        "WHERE author_id = 'brand' OR contains(lower(text), 'the')",
    "min_length_filter": f"SELECT doc_id AS id, {collapse('text')} AS customer_text FROM documents "
                         f"WHERE length({collapse('text')}) >= 15",
    "length_band_filter": "SELECT doc_id AS id, text AS customer_text FROM documents "
                          "WHERE length(text) BETWEEN 20 AND 260",
    "any_keyword": f"SELECT doc_id AS id, {has('lower(text)', 'license', '&&&', 'idiot', ' von ')} AS hit "
                   "FROM documents",
    "word_boundary_match": "SELECT doc_id AS id, "
                           f"{has_word('lower(text)', 'idiot', 'loser', 'of the', 'éon', 'thble')} AS hit FROM documents",
    "reply_pairs": f"WITH {pairs_cte(True)} SELECT * FROM pairs",
    "duplicate_keys": "SELECT text AS customer_text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1",
    "leakage_anti_join": f"WITH {KEPT} SELECT * FROM kept",
    "seed_union": f"WITH {KEPT}, {WEAK} SELECT 0 AS priority, id, customer_text, intent FROM gold "
                  "UNION ALL SELECT 1, id, customer_text, intent FROM weak",
    "dedup_keep_first": f"WITH {DOCS} SELECT * FROM docs "
                        "QUALIFY row_number() OVER (PARTITION BY customer_text ORDER BY id) = 1",
    "capped_pairs": f"WITH {pairs_cte(False)} SELECT * FROM "
                    "(SELECT * FROM pairs ORDER BY response_id LIMIT 100) "
                    "QUALIFY row_number() OVER (PARTITION BY customer_text ORDER BY response_id) = 1",
    "weak_training_set": f"""WITH {KEPT}, {WEAK}, both_parts AS (
  SELECT 0 AS priority, id, customer_text, intent FROM gold
  UNION ALL (SELECT 1, id, customer_text, intent FROM weak ORDER BY id
             LIMIT greatest(0, 5000 - (SELECT count(*) FROM gold))))
SELECT * FROM both_parts""",
    "fit_certificate": f"""WITH {KEPT}, {WEAK}, weak_part AS (
  SELECT intent FROM weak ORDER BY id LIMIT greatest(0, 5000 - (SELECT count(*) FROM gold))),
rows_of AS (SELECT intent FROM gold UNION ALL SELECT intent FROM weak_part)
SELECT s.settings, intent, count(*) AS n, true AS converged
FROM rows_of, (VALUES ('simple'), ('production')) s(settings) WHERE intent IS NOT NULL GROUP BY ALL""",
    "quota_sample": f"""WITH {CANDIDATES}, {QUOTAS}, accepted AS (
  SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY id) AS k FROM candidates) c
  JOIN quotas USING (intent) WHERE k <= target)
SELECT row_number() OVER (ORDER BY id) AS id, id AS tweet_id, intent, customer_text
FROM (SELECT * FROM accepted ORDER BY id LIMIT 200)""",
    "quota_sample_after_seeds": f"""WITH {CANDIDATES}, {GOLD}, {SEEDS}, {ROOM}, accepted AS (
  SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY id) AS k FROM candidates) c
  JOIN room USING (intent) WHERE k <= room)
SELECT (SELECT count(*) FROM seeds) + row_number() OVER (ORDER BY id) AS id, id AS tweet_id, intent, customer_text
FROM (SELECT * FROM accepted ORDER BY id LIMIT greatest(0, 200 - (SELECT count(*) FROM seeds)))""",
    "topup_fill": f"""WITH {GOLD}, have AS (SELECT count(*) AS n, max(id) AS last FROM gold)
SELECT id, customer_text, intent, should_escalate FROM gold
UNION ALL
SELECT last + 1 + i - n, 'My device has issues after 11.0.' || (i % 4)::VARCHAR, 'en', false
FROM (SELECT unnest(range(n, 500)) AS i, n, last FROM have)""",
    "sample_cases": f"WITH {GOLD} SELECT * FROM gold ORDER BY id LIMIT 5",
    "normalize_text": "SELECT doc_id AS id, " + collapse(
        f"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '@{W}+', ' ', 'g'), "
        f"'https?://[^{SPACES}]+', ' ', 'g'), '[^\\x00-\\x7F]+', ' ', 'g')") + " AS clean FROM documents",
    "collapse_ws": f"SELECT doc_id AS id, {collapse('text')} AS clean FROM documents",
    "sanitize_reply": f"WITH {MESSAGES} SELECT tweet_id, {sanitize('text')} AS clean FROM messages WHERE NOT inbound",
    "repair_text": f"SELECT doc_id AS id, {repair('text')} AS clean FROM documents",
    "truncate_reply": f"WITH {MESSAGES} SELECT tweet_id, substring(text, 1, 280) AS reply, "
                      "substring(text, 1, 90) AS preview_90, substring(text, 1, 120) AS preview_120, "
                      "substring(text, 1, 140) AS preview_140 FROM messages",
    "tokenize_words": f"SELECT doc_id AS id, len(t)::INT AS n, array_to_string(t, ' ') AS tokens FROM "
                      f"(SELECT doc_id, regexp_extract_all(lower(text), '{W}+') AS t FROM documents)",
    "tokenize_terms": f"SELECT doc_id AS id, "
                      f"array_to_string(regexp_extract_all(lower(text), '{LONG}'), ' ') AS long_words, "
                      f"array_to_string(regexp_extract_all(lower(text), '{HYPHEN}'), ' ') AS hyphen_words FROM documents",
    "ngrams": f"""WITH t AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '{LONG}') AS t FROM documents),
g AS (SELECT id, flatten([t,
  list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
  list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])]) AS g FROM t)
SELECT id, len(g)::INT AS n, array_to_string(g, '|') AS grams FROM g""",
    "fragment_flag": f"WITH {DOCS} SELECT id, {IS_FRAGMENT} AS fragment FROM docs",
    "out_of_scope_flag": f"WITH {DOCS} SELECT id, {IS_OUT} AS out_of_scope FROM docs",
    "weak_labels": f"WITH {DOCS}, kept AS (SELECT * FROM docs), {WEAK} SELECT id, intent FROM weak",
    "rule_intent": f"WITH {CANDIDATES} SELECT id, intent, customer_text FROM candidates",
    "stratum_rules": f"WITH {DOCS}, kept AS (SELECT * FROM docs), {WEAK} "
                     f"SELECT id, intent, {stratum_columns('customer_text')} FROM weak",
    "escalation_decision": f"{DECIDED} SELECT id, intent, should_escalate, reason, risk_level, trigger_rule FROM decided",
    "keyword_escalation": f"""WITH {DOCS}, hits AS (
  SELECT id, {has('lower(customer_text)', 'idiot', 'trash', 'license')} AS h FROM docs)
SELECT id, h AS should_escalate, CASE WHEN h THEN 'keyword' ELSE 'no keyword' END AS reason,
       CASE WHEN h THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, 'KEYWORD_RULE' AS trigger_rule FROM hits""",
    "trigger_breakdown": f"{DECIDED} SELECT trigger_rule, risk_level, count(*) AS n FROM decided GROUP BY ALL",
    "topic_route": f"""WITH {DOCS}, {linear_sql('docs')},
routed AS (SELECT id, {TOPIC} AS topic FROM docs JOIN lin_best USING (id))
SELECT id, topic, {TOPIC_REPLY} AS topic_reply FROM routed""",
    "draft_reply": f"""{DECIDED}, with_best AS (SELECT *, customer_text AS best FROM decided), {drafted_sql('best')}
SELECT id, trigger_rule, topic, drafted_reply FROM drafted""",
    "length_compliance": f"""WITH {MESSAGES}
SELECT CASE WHEN inbound THEN 'customer' ELSE 'agent' END AS side, count(text) AS n,
       count(*) FILTER (length(text) <= 280) AS compliant,
       count(*) FILTER (length(text) <= 280) / count(text) AS rate FROM messages GROUP BY 1""",
    "tfidf_vocab": f"WITH {DOCS}, {grams_sql('docs', 'id', 'customer_text', HYPHEN, 3, '', 'd')}, "
                   f"{vocabulary_sql('d', 'docs', 12000)} SELECT term, cf, df FROM voc",
    "tfidf_weights": f"WITH {DOCS}, {grams_sql('docs', 'id', 'customer_text', LONG, 2, '', 'd')}, "
                     f"{vocabulary_sql('d', 'docs', 5000)}, {weights_sql('d', 'id', False)} "
                     "SELECT id, term, round(weight, 6) AS weight FROM d_w",
    "tfidf_index": f"WITH {INDEX} SELECT inquiry_id AS doc_id, term, round(weight, 6) AS weight FROM d_w",
    "tfidf_cosine": f"""WITH {INDEX}, turns AS (SELECT tweet_id AS id, text AS customer_text FROM messages WHERE inbound),
{scores_sql('turns')}
SELECT id, count(*) AS n_cases, max(score) AS top_score, round(sum(score), 6) AS total_score FROM scores GROUP BY id""",
    "topk_retrieval": f"""WITH {TURNS}, corpus AS (SELECT doc_id AS inquiry_id, text AS customer_text FROM documents),
{grams_sql('corpus', 'inquiry_id', 'customer_text', LONG, 2, STOP, 'd')},
{vocabulary_sql('d', 'corpus')}, {weights_sql('d', 'inquiry_id', True)}, {scores_sql('turns')}
SELECT id, doc_id, score, rank FROM ranked WHERE rank <= 3""",
    "nearest_1": f"""WITH {INDEX}, {DOCS}, {scores_sql('docs')}
SELECT docs.id, coalesce(round(r.score, 4), 0) AS retrieval_score, (r.id IS NOT NULL)::INT AS n_cases,
       r.doc_id AS case_id, c.agent_text AS resolution
FROM docs LEFT JOIN ranked r ON r.id = docs.id AND r.rank = 1 LEFT JOIN corpus c ON c.inquiry_id = r.doc_id""",
    "class_weights": "SELECT lang, count(*) AS n, "
                     "round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight "
                     "FROM documents GROUP BY lang",
    "majority_class": "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 1",
    "linear_score": f"WITH {DOCS}, {linear_sql('docs')} SELECT id, label, round(score, 6) AS score, "
                    "round(probability, 6) AS probability FROM lin_probs",
    "confidence_damping": f"WITH {DOCS}, {linear_sql('docs')} SELECT id, intent, round({DAMPED}, 6) AS confidence "
                          "FROM docs JOIN lin_best USING (id)",
    "fallback_decision": f"WITH {DOCS}, {decided_sql('docs', FALLBACK)} "
                         "SELECT id, intent, confidence, should_escalate, reason, risk_level, trigger_rule FROM decided",
    "heuristic_override": f"{DECIDED} SELECT id, intent, confidence FROM classified",
    "trivial_triage": f"""SELECT doc_id AS id, 'en' AS intent, 1.0::DOUBLE AS confidence, false AS should_escalate,
       'never' AS reason, 'LOW' AS risk_level, 'TRIVIAL_DEFAULT' AS trigger_rule,
       {_TRIVIAL_REPLY} AS drafted_reply FROM documents""",
    "simple_triage": f"""WITH {INDEX}, {DOCS}, {scores_sql('docs')}, {linear_sql('docs')}, {simple_sql('docs')}
SELECT id, intent, round(confidence, 6) AS confidence, should_escalate,
       CASE WHEN should_escalate THEN 'keyword' ELSE 'no keyword' END AS reason,
       CASE WHEN should_escalate THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
       'KEYWORD_RULE' AS trigger_rule, drafted_reply, retrieval_score FROM simple""",
    "production_triage": f"""WITH {DOCS}, {production_sql('docs')}
SELECT {FULL}, topic, retrieval_score, coalesce(cases, '') AS cases FROM drafted LEFT JOIN case_lists USING (id)""",
    "stream_triage": "WITH turns AS (SELECT conv_id * 4294967296 + turn AS id, text AS customer_text FROM conversations "
                     f"WHERE role = 'user'), {production_sql('turns')} SELECT {FULL}, retrieval_score FROM drafted",
    "confusion_counts": f"WITH {LABELLED} SELECT truth, predicted, count(*) AS n FROM labelled GROUP BY ALL",
    "accuracy": f"WITH {LABELLED} SELECT round(avg((truth = predicted)::INT), 4) AS accuracy FROM labelled",
    "per_class_prf": f"WITH {CLASSES} SELECT label, support, round(p, 4) AS precision, round(r, 4) AS recall, "
                     "round(f, 4) AS f1 FROM classes",
    "macro_prf": f"WITH {CLASSES} SELECT round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall, "
                 "round(avg(f), 4) AS macro_f1 FROM classes",
    "escalation_metrics": f"""WITH {GOLD_MESSAGES}, {decided_sql('asked')}, counts AS (
  SELECT count(*) FILTER (g.should_escalate AND d.should_escalate) AS tp,
         count(*) FILTER (NOT g.should_escalate AND d.should_escalate) AS fp,
         count(*) FILTER (g.should_escalate AND NOT d.should_escalate) AS fn,
         count(*) FILTER (NOT g.should_escalate AND NOT d.should_escalate) AS tn
  FROM gold g JOIN decided d USING (id)),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r,
             coalesce(fn / nullif(tp + fn, 0), 0) AS far FROM counts)
SELECT tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall,
       round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1, round(far, 4) AS false_auto_handle_rate FROM r""",
    "bleu4": f"WITH {DRAFT_TOKENS}, {BLEU} SELECT id, round(b, 6) AS bleu_4 FROM bleus",
    "rouge_l": f"WITH RECURSIVE {DRAFT_TOKENS}, {ROUGE} SELECT id, round(f, 6) AS rouge_l FROM rouges",
    "pair_cosine": f"WITH {DRAFTS}, {COSINE} SELECT id, round(c, 6) AS cosine_similarity FROM cosines",
    "lexical_summary": f"""WITH RECURSIVE {DRAFT_TOKENS}, {BLEU}, {ROUGE}, {COSINE}
SELECT round((SELECT avg(b) FROM bleus), 4) AS bleu_4, round((SELECT avg(f) FROM rouges), 4) AS rouge_l,
       round((SELECT avg(c) FROM cosines), 4) AS cosine_similarity""",
    "rubric_scores": f"""WITH {RATED} SELECT response_id, g AS groundedness, a AS actionability, t AS brand_tone,
  o AS judge_overall, printf('Groundedness: %d/5, Actionability: %d/5, Brand Tone: %d/5.', g, a, t) AS judge_reasoning
FROM scored""",
    "rubric_summary": f"""WITH {RATED} SELECT should_escalate, round(avg(g), 2) AS groundedness,
  round(avg(a), 2) AS actionability, round(avg(t), 2) AS brand_tone, round(avg(o), 2) AS judge_overall
FROM scored GROUP BY should_escalate""",
    "detailed_predictions": f"WITH {DETAILED} SELECT * EXCLUDE (customer_text) FROM detailed",
    "explore_filter": f"""WITH {DETAILED} SELECT id, difficulty_stratum, customer_text, gold_intent, predicted_intent,
  gold_escalate, predicted_escalate, drafted_reply, judge_overall FROM detailed
WHERE gold_intent = 'en' AND (NOT intent_match OR NOT escalation_match)""",
    "explore_count": f"WITH {DETAILED} SELECT count(*) AS n FROM detailed WHERE intent_match AND escalation_match",
    "facet_values": f"""WITH {GOLD} SELECT DISTINCT 'difficulty_stratum' AS facet, difficulty_stratum AS value FROM gold
WHERE difficulty_stratum IS NOT NULL UNION ALL SELECT DISTINCT 'gold_intent', intent FROM gold WHERE intent IS NOT NULL""",
    "system_comparison": f"""WITH RECURSIVE {ALL_METRICS}
SELECT metric_group, metric, max(value) FILTER (system = 'trivial')::DOUBLE AS trivial,
       max(value) FILTER (system = 'simple')::DOUBLE AS simple,
       max(value) FILTER (system = 'production')::DOUBLE AS production
FROM long GROUP BY metric_group, metric""",
    "metrics_through_json": f"""WITH RECURSIVE {ALL_METRICS}
SELECT system, metric_group, metric, value::DOUBLE AS value FROM long""",
    "recall_vs_far": f"""WITH {ALL_SYSTEMS}
SELECT system, 'recall_pct' AS measure, round(r * 100, 4)::DOUBLE AS value FROM esc_rates
UNION ALL SELECT system, 'far_pct', round(far * 100, 4)::DOUBLE FROM esc_rates""",
    "breakdown_counts": f"""WITH {GOLD}
SELECT 'intent' AS facet, intent AS value, count(*) AS n FROM gold GROUP BY intent
UNION ALL SELECT 'should_escalate', should_escalate::VARCHAR, count(*) FROM gold GROUP BY should_escalate
UNION ALL SELECT 'difficulty_stratum', difficulty_stratum, count(*) FROM gold GROUP BY difficulty_stratum""",
    "agreement_rates": f"""WITH {RATES} SELECT dimension, n AS sample_size, round(exact, 4) AS exact_agreement_pct,
  round(adjacent, 4) AS adjacent_agreement_pct, round(bias, 4) AS mean_bias FROM rates""",
    "weighted_kappa": f"WITH {RATINGS}, {KAPPA} SELECT dimension, round(k, 6) AS kappa FROM kappas",
    "rater_pearson": f"WITH {RATINGS} SELECT dimension, round(corr(a, b), 6) AS pearson_r FROM ratings GROUP BY dimension",
    "agreement_macro": f"""WITH {RATES}, {KAPPA}
SELECT round(avg(round(k, 4)), 4) AS mean_kappa, round(avg(round(exact, 2)), 2) AS mean_exact_agreement_pct,
       round(avg(round(adjacent, 2)), 2) AS mean_adjacent_agreement_pct FROM rates JOIN kappas USING (dimension)""",
    "evaluation_set": f"""WITH {CORPUS}, {QUOTAS}, repaired AS (
  SELECT response_id, {repair('customer_text')} AS customer_text, {repair('agent_text')} AS reference_resolution
  FROM corpus),
candidates AS (
  SELECT * FROM (SELECT *, {lexicon('lower(customer_text)', LEXICON_2)} AS intent FROM repaired
    WHERE length(customer_text) BETWEEN 20 AND 260) WHERE intent IS NOT NULL),
accepted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY response_id) AS k FROM candidates)
  JOIN quotas USING (intent) WHERE k <= target ORDER BY response_id LIMIT 200)
SELECT row_number() OVER (ORDER BY response_id) AS id, customer_text, intent,
       {stratum_columns('customer_text')}, reference_resolution FROM accepted""",
    "evaluation_set_after_seeds": f"""WITH {CORPUS}, {GOLD}, {SEEDS}, {ROOM}, repaired AS (
  SELECT response_id, {repair('customer_text')} AS customer_text, {repair('agent_text')} AS reference_resolution
  FROM corpus),
candidates AS (
  SELECT * FROM (SELECT *, {lexicon('lower(customer_text)', LEXICON_2)} AS intent FROM repaired
    WHERE length(customer_text) BETWEEN 20 AND 260) WHERE intent IS NOT NULL),
accepted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY response_id) AS k FROM candidates)
  JOIN room USING (intent) WHERE k <= room ORDER BY response_id LIMIT greatest(0, 200 - (SELECT count(*) FROM seeds)))
SELECT id, customer_text, intent, should_escalate, escalation_reason, difficulty_stratum, reference_resolution FROM seeds
UNION ALL BY NAME
SELECT (SELECT count(*) FROM seeds) + row_number() OVER (ORDER BY response_id) AS id, customer_text, intent,
       {stratum_columns('customer_text')}, reference_resolution FROM accepted""",
    "messages_through_csv": f"""WITH {MESSAGES} SELECT tweet_id, author_id, inbound, text,
  NULL::VARCHAR AS response_tweet_id, in_response_to_tweet_id FROM messages""",
    "evaluation_items_through_json": f"""WITH {GOLD} SELECT id, customer_text, intent, should_escalate,
  escalation_reason, difficulty_stratum, reference_resolution FROM gold""",
    "calibration_through_json": """WITH scored AS (
  SELECT o_orderkey::INT AS item_id, left(o_orderpriority, 1)::INT AS a,
         least(floor(o_totalprice / 100000) + 1, 5)::INT AS b FROM orders)
SELECT item_id, 'groundedness' AS dimension, a AS rater_a, b AS rater_b FROM scored
UNION ALL SELECT item_id, 'actionability', b, b FROM scored
UNION ALL SELECT item_id, 'brand_tone', 6 - a, a FROM scored""",
    "predictions_through_csv": f"WITH {DETAILED} SELECT * EXCLUDE (customer_text, trigger_rule) FROM detailed",
}

# Messages that come twice are answered once.
ORACLES["stream_triage_repeats"] = ORACLES["stream_triage"]
