"""Prompt texts of the dataset-building workflow.

FIXED VALUES. Everything below must equal, byte for byte, the texts the
original scripts send or build; they are stated once, in reading order, and
only split at their placeholder by code (``split_template``).
"""

from __future__ import annotations

# --- FIXED VALUES: variant kinds, in the order the workflow runs them -------
KINDS = ("ambiguous", "inconsistent", "incomplete")

# --- FIXED VALUES: rewrite prompts (problem -> modified problem) -------------
REWRITE_TEMPLATES = {
    "ambiguous": """
Based on the knowledge that ambiguous problem descriptions can be created by introducing multiple valid interpretations or unspecified details, think step-by-step to rewrite the given coding problem description and make it ambiguous. Only output the modified problem description itself.

Original Problem Description:
{question}

Ambiguous Problem:
""",
    "inconsistent": """
Based on the knowledge that a problem becomes inconsistent if some statements in the description show conflict, think step-by-step to rewrite the given coding problem description and make it inconsistent. Only output the modified problem description itself.

Original Problem Description:
{question}

Inconsistent Problem:
""",
    "incomplete": """
Based on the knowledge that removing some of the key concepts and conditions that are crucial for solving the problem makes it incomplete, think step-by-step to rewrite the given coding problem description to make it incomplete. Only output the modified problem description itself.

Original Problem Description:
{question}

Incomplete Problem:
""",
}

# --- FIXED VALUES: clarifying-question prompts (modified problem -> questions)
QUESTION_TEMPLATES = {
    "ambiguous": """
You are given an ambiguous coding problem description. Your task is to think step-by-step to assess the level of ambiguity and ask necessary clarifying questions to resolve the ambiguity. Please note that a problem statement is ambiguous if it includes multiple valid interpretations or has unspecified details.

Ambiguous Coding Problem Description:
{question}

Please only output the clarifying questions.
""",
    "inconsistent": """
You are given an inconsistent coding problem description. Your task is to think step-by-step to assess the level of inconsistency and ask necessary clarifying questions to resolve the inconsistency. Please note that a problem description becomes inconsistent if some statements in the description show conflict.

Inconsistent Coding Problem Description:
{question}

Please only output the clarifying questions.
""",
    "incomplete": """
You are given an incomplete coding problem description. Your task is to think step-by-step to assess the level of incompleteness and ask necessary clarifying questions to resolve the incompleteness. Please nore that absence of some of the key concepts and conditions that are crucial for solving the problem makes it incomplete.

Incomplete Coding Problem Description:
{question}

Output Format:

Please only output the clarifying questions.
""",
}

# --- FIXED VALUES: paired prompts (original + variant -> questions) ----------
# Documented, never coded upstream. Indentation of the documentation and
# trailing blanks at line ends are removed; {original} and {variant} stand for
# the two "<>" slots in the order they appear.
PAIRED_TEMPLATES = {
    "ambiguous": """You are given a coding problem description and an ambiguous version of the same problem. Your task is to assess the ambiguous problem description, identify specific points of ambiguity, and ask necessary clarifying questions to resolve the ambiguity and reach the clarity present in the original problem. Please note that a problem statement is ambiguous if it includes multiple valid interpretations or has unspecified details.

Original Coding Problem Description: {original}

Ambiguous Coding Problem Description: {variant}

When generating these questions, do not mention the original problem description in any way. Frame the clarifying questions without acknowledging the existence of the original version.

Please only output the clarifying questions, ensuring that each question targets a specific point of ambiguity to achieve clarity similar to the original problem.""",
    "inconsistent": """You are given a coding problem description and an inconsistent version of the same problem. Your task is to assess the inconsistent problem description, identify specific points of inconsistency, and ask necessary clarifying questions to resolve the inconsistency and reach the clarity present in the original problem. Please note that a problem description becomes inconsistent if some statements in the description show conflict.

Original Coding Problem Description: {original}

Inconsistent Coding Problem Description: {variant}

When generating these questions, do not mention the original problem description in any way. Frame the clarifying questions without acknowledging the existence of the original version.

Please only output the clarifying questions, ensuring that each question targets a specific point of inconsistency to achieve clarity similar to the original problem.""",
    "incomplete": """You are given a coding problem description and an incomplete version of the same problem. Your task is to assess the incomplete problem description, identify specific points of incompleteness, and ask necessary clarifying questions to resolve the incompleteness and reach the clarity present in the original problem. Please nore that absence of some of the key concepts and conditions that are crucial for solving the problem makes it incomplete.

Original Coding Problem Description: {original}

Incomplete Coding Problem Description: {variant}

When generating these questions, do not mention the original problem description in any way. Frame the clarifying questions without acknowledging the existence of the original version.

Please only output the clarifying questions, ensuring that each question targets a specific point of incompleteness to achieve clarity similar to the original problem.""",
}

# --- FIXED VALUES: instruction-tuning text (tokenizer variant 4) -------------
V4_QUESTION_PROMPT = "You are an expert software developer who writes high quality code. With below information, please either generate Python3 code (Respond directly with code only with markdown), or ask clarifying questions:\n"
V4_ANSWER_PROMPT_ORIGINAL = "This is a clear problem requiring no clarifications. Let's generate the required Python3 code directly in markdown."
V4_ANSWER_PROMPT_OTHER = "I have a few clarifying questions. Please respond with the necessary details so I can assist further."

# --- FIXED VALUES: preference data -------------------------------------------
PREFERENCE_PROMPT_PREFIX = "Problem: "
PREFERENCE_PROMPT_SUFFIX = "\n\nSolution:"
REJECTION_PROMPT_ORIGINAL = (
    "Given the following correct code, generate poorly formulated clarifying questions "
    "that are vague, irrelevant, misleading, or do not help resolve ambiguities:\n\n"
)
REJECTION_PROMPT_OTHER = (
    "Given the following set of clarifying questions, generate an incorrect version of the code "
    "by introducing logical or syntactical errors while maintaining its general structure:\n\n"
)

# --- FIXED VALUES: misc --------------------------------------------------------
ORIGINAL = "Original"                 # the one class compared case-sensitively
TAG_SEPARATOR = " ->: "               # text + separator + list repr of tags
GENERATION_PARAMS = '{"max_output_tokens":2048,"temperature":0.1,"top_k":1,"top_p":1}'
PAD_ID, UNK_ID, BOS_ID, EOS_ID = 0, 1, 2, 3
IGNORE_INDEX = -100


def split_template(template: str, slot: str = "{question}") -> tuple[str, str]:
    """Text before and after the single ``slot`` of ``template``."""
    before, sep, after = template.partition(slot)
    if not sep or slot in after:
        raise ValueError(f"template must contain {slot!r} exactly once")
    return before, after
