"""Prompt templates (B11) and the label -> reference sentence map.

Templates are written as blocks whose lines are folded like YAML plain scalars:
lines of one paragraph join with a blank, and a blank line becomes a newline.
"""

from __future__ import annotations

# ---- fixed values: templates of the claim task and of the short-answer task --------
_CLAIM_HEAD = """You are a fact checking assistant.
Your task is to determine whether the context supports, refutes, or does not provide enough information about the claim.

"Context:"
-------------
{context_str}
-------------

"Claim:"
{query_str}
"""

_CLAIM_TAIL = """Output strictly in valid JSON format only, with no extra text, explanations, or comments.

"Output format:"
{
"label:" "SUPPORTS" | "REFUTES" | "NOTENOUGHINFO",
"response:" "short, direct evidence extracted or paraphrased from context"
}

"Follow these rules carefully:"
1. "SUPPORTS:" if the context explicitly confirms the claim.
2. "REFUTES:" if the context explicitly contradicts the claim.
3. "NOTENOUGHINFO:" if the context lacks direct or clear information about the claim, even if it is indirectly related or mentions similar facts.
4. "response" must be a short, direct evidence to justify your selected label, based on the context.
"""

_CLAIM_PARAPHRASE = """First, paraphrase the claim with additional context for clarity and detail. Ensure the meaning or the facts in the claim does not change.
Then, check the factuality of the revised claim based on the above context only.
"""

_CLAIM_SIMPLIFY = """First, rewrite the claim to eliminate nested clauses or complex syntax. Ensure the claim does not become off-topic.
Then, check the factuality of the revised claim based on the above context only.
"""

_SHORT_HEAD = """You are a helpful assistant.

"Context:"
-------------
{context_str}
-------------
"""

_SHORT_RULES = """Only answer from the Context. Do not answer based on your own knowledge ot prior belief.
If the answer does not exist in the context, respond with 'The provided context is insufficient regarding ...'.
For yes/no questions, you must repond with a long answer containing "yes" or "no".
For questions with "who", "what", "which", "how", "where", and "when", you should repond with a long answer.
Do not output the revised question.
"""

_SHORT_SIMPLE = """Answer the following Question based on the above Context only. Only answer from the Context. If the answer does not exist in the context, respond with 'The provided context is insufficient regarding ...'.
For yes/no questions, you must repond with a long answer containing "yes" or "no".
For questions with "who", "what", "which", "how", "where", and "when", you should repond with a long answer.

"Question:"
{query_str}
"""

_SHORT_PARAPHRASE = """Paraphrase the following Question with additional context for clarity and detail. Then answer the revised question based on the above Context only.

"Question:"
{query_str}
"""

_SHORT_SIMPLIFY = """Rewrite the following Question to eliminate nested clauses or complex syntax. Ensure it does not become off-topic. Then answer the revised question based on the above Context only.

"Question:"
{query_str}
"""

LABEL_SENTENCES = {
    "SUPPORTS": "The claim in this statement is correct.",
    "REFUTES": "The claim in this statement is wrong.",
    "NOTENOUGHINFO": "There is not enough information about the claim in this statement.",
}
# -------------------------------------------------------------------------------------


def fold(block: str) -> str:
    """YAML plain-scalar folding: a line break inside a paragraph becomes a blank,
    an empty line becomes a newline."""
    paras = [" ".join(line.strip() for line in p.strip("\n").split("\n")) for p in block.strip("\n").split("\n\n")]
    return "\n".join(p for p in paras)


def _join(*blocks: str) -> str:
    return fold("\n\n".join(b.strip("\n") for b in blocks))


TEMPLATES = {
    ("claim", "simple_qa"): _join(_CLAIM_HEAD, _CLAIM_TAIL),
    ("claim", "paraphrase_qa"): _join(_CLAIM_HEAD, _CLAIM_PARAPHRASE, _CLAIM_TAIL),
    ("claim", "simplify_qa"): _join(_CLAIM_HEAD, _CLAIM_SIMPLIFY, _CLAIM_TAIL),
    ("short", "simple_qa"): _join(_SHORT_HEAD, _SHORT_SIMPLE),
    ("short", "paraphrase_qa"): _join(_SHORT_HEAD, _SHORT_PARAPHRASE, _SHORT_RULES),
    ("short", "simplify_qa"): _join(_SHORT_HEAD, _SHORT_SIMPLIFY, _SHORT_RULES),
}
