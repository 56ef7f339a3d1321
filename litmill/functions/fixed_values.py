"""Word lists, patterns and constants that results must agree on.

They are kept here as plain text so that operators stay free of literals. Every one can be
overridden through the parameters of the operator that uses it.
"""

from __future__ import annotations

# ---- fixed values: text cleaning ------------------------------------------------------
NUMERIC_CITATION = r"\[(?:\s*\d+\s*(?:[-–]\s*\d+\s*)?)(?:\s*,\s*\d+\s*(?:[-–]\s*\d+\s*)?)*\]"
YEAR_IN_PARENTHESES = r"\(\s*\d{4}\s*\)"
BULLETS = r"[•▪■►◆▶●◦]"
RULER = r"-{3,}|={3,}|_{3,}|\*{3,}"
DISPLAY_LATEX = (r"(?s)\\\[(.*?)\\\]", r"(?s)\$\$(.*?)\$\$")
INLINE_LATEX = r"(?s)\$(?!\s)(.*?)(?<!\s)\$"

ABBREVIATIONS = {
    "llms": "Large Language Models",
    "llm": "Large Language Model",
    "kg": "Knowledge Graph",
    "kgs": "Knowledge Graphs",
    "nlp": "Natural Language Processing",
    "gnn": "Graph Neural Network",
    "transformer": "Transformer Architecture",
    "cnn": "Convolutional Neural Network",
    "rnn": "Recurrent Neural Network",
}

BACK_MATTER_HEADINGS = [
    "references", "bibliography", "acknowledgment", "acknowledgements", "appendix",
    "supplementary material", "author contributions", "ethics statement", "data availability",
    "conflict of interest", "funding",
]

SECTION_HEADINGS = [
    "Abstract", "Introduction", "Background", "Related Work", "Preliminaries", "Methodology", "Methods",
    "Approach", "Model Architecture", "Model", "Architecture", "Implementation", "Training", "Datasets",
    "Benchmarks", "Experimental Setup", "Setup", "Experiments", "Results", "Evaluation", "Analysis",
    "Ablation", "Discussion", "Limitations", "Future Work", "Conclusion", "Contributions", "Key Findings",
    "Findings", "Proposed Method",
]

SECTION_STEMS = [
    "abstract", "introduction", "background", "related", "prelim", "method", "approach", "model",
    "architect", "implement", "train", "dataset", "benchmark", "experimental", "setup", "experiment",
    "result", "evaluat", "analysis", "ablation", "discuss", "limit", "future", "conclus", "contribution",
    "finding", "proposed",
]

PROMPT_ARTEFACTS = [
    r"Question:\s*", r"Answer:\s*", r"Context:\s*", r"Instructions?:\s*", r"System:\s*",
    r"Assistant:\s*", r"User:\s*", r"\[INST\].*?\[/INST\]", r"<s>.*?</s>", r"```instructions?.*?```",
]

ANSWER_LABELS = [
    (r"(?i)\bShort Summary\s+Short\b", "Short Summary"),
    (r"(?i)\bExplanation\s+Short\b", "Explanation"),
    (r"(?is)```(?:instructions?|system|rules?).*?```", ""),
]
SYMBOL_RUN = r"(?i)(?:\b[prdqxyRNAGT\-ηθ∑∏⊤≈∈\(\)\[\]\|:\.]+\s*){12,}"
EMPTY_LABEL = r"(?i)\b(Evidence from paper|Explanation|Short Summary)\s*[:\-]?\s*(?=\n|$)"
TRUNCATION_MARK = "\n\n[... truncated for processing ...]"

# ---- fixed values: page and section markers -------------------------------------------
PAGE_MARKER = r"(?i)\n\s*---\s*Page\s*(\d+)\s*---\s*\n"
PAGE_LINE = r"\n*--- Page \d+ ---\n*"
PAGE_SECTION_HEADINGS = [
    r"abstract", r"introduction", r"background", r"related work", r"method(?:ology)?", r"experiments?",
    r"results?", r"discussion", r"conclusions?", r"references",
]
LINE_HEADING_PATTERNS = [
    r"^\d+\.?\s+[A-Z]",
    r"^[IVX]+\.?\s+[A-Z]",
    r"^(Abstract|Introduction|Methods|Results|Discussion|Conclusion|References)",
]

# ---- fixed values: content types, chunk ranking ---------------------------------------
CONTENT_TYPES = {
    "methodology": ["method", "approach", "algorithm", "procedure"],
    "results": ["result", "experiment", "evaluation", "performance"],
    "introduction": ["introduction", "background", "motivation"],
    "conclusion": ["conclusion", "summary", "future work"],
}

PRIORITY_KEYWORDS = [
    "method", "architecture", "model", "transformer", "attention",
    "experiment", "results", "evaluation", "dataset", "benchmark",
    "training", "loss", "approach", "encoder", "decoder",
    "proposed", "compared", "achieves", "outperforms",
    "baseline", "metric", "accuracy", "f1", "bleu",
    "ablation", "limitation", "hyperparameter", "contribution",
]

CHUNK_KEYWORD_STOP_WORDS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for"]

# Context lines around an element and its priority, per chunk type.
CONTEXT_WINDOW = {"equation": 6, "table": 2, "figure": 2, "text": 0}
CONTENT_PRIORITY = {"equation": 1.5, "table": 1.3, "figure": 1.2, "text": 1.0}

# ---- fixed values: equations ------------------------------------------------------------
PROSE_WORDS = [
    "the", "is", "are", "was", "were", "this", "that", "these", "those",
    "we", "our", "their", "your", "in", "of", "for", "with", "and", "to",
    "a", "an", "as", "by", "from", "on", "at", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "can", "could", "will",
    "would", "should", "may", "might", "must", "shall",
]
EQUATION_OPERATORS = ["=", "∝", "→", "←", "≡", "≈", "≤", "≥", "∫", "∑", "∏"]
MATH_SIGNALS = [
    r"\\exp", r"\\log", r"\\sum", r"\\prod", r"\\int",
    r"\\alpha", r"\\beta", r"\\gamma", r"\\theta", r"\\eta",
    r"\\propto", r"\\approx", r"\\leq", r"\\geq",
    r"[=∑∏∫∝∈]",
    r"\bexp\b", r"\blog\b", r"\bsoftmax\b", r"\bargmax\b",
    r"[αβγδεηθλμνπρστφψω]",
]
EQUATION_CAPTION = r"(?i)^\s*(Figure|Fig|Table|Appendix|Algorithm|Listing)\s+\d"
EQUATION_FUNCTION = r"(?i)\b(exp|log|sin|cos|tan|max|min|argmax|argmin|softmax|sigmoid)\s*\("
CONDITIONAL_PROBABILITY = r"\b[pqPQ][_\\]?[\w\\]+\([^)]*\|[^)]*\)"
STRONG_OPERATORS = ["=", "≈", "≤", "≥", "∫", "∑", "∏", "∝", "→", "∈", "≡"]
STRONG_GREEK = "αβγδεηθλμπστφψω"
EQUATION_LINK = r"(?i)(https?://|www\.|doi:|arxiv:|\.pdf)"
EQUATION_CAPTION_WORD = r"(?i)^\s*(Figure|Fig|Table|Appendix|Algorithm)\b"
VARIABLE_GREEK = "αβγδεζηθικλμνξπρστυφχψω"
FIGURE_WORD = r"(?i)\b(figure|fig\.|table|equation|eq\.)\b"
MATH_SYMBOLS = "∑∏∫∂∇αβγδεζηθλμνπρσφψωΩΓΔΘΛΞΠΣΦΨ≈≠≤≥←→⇒⇔∈∉∅∞±×÷√"

# ---- fixed values: references to numbered elements ---------------------------------------
ELEMENT_REFERENCE = {
    "equation": r"\b(?:equation|eq\.)\s*#?\s*(\d+)\b",
    "table": r"\b(?:table|tbl\.)\s*#?\s*(\d+)\b",
    "figure": r"\b(?:figure|fig\.)\s*#?\s*(\d+)\b",
}

# ---- fixed values: document metadata ------------------------------------------------------
ARXIV_ID = r"(\d{4}\.\d{4,5})(v\d+)?"
TITLE_SKIP = r"^(abstract|introduction|arxiv|submitted|accepted|keywords)\b"
NOT_A_NAME = ["Retrieval", "Generation", "Knowledge", "Intensive", "Tasks", "Abstract", "Introduction"]
AFFILIATION = (
    r"(?i)\b(university|institute|facebook|meta|google|microsoft|openai|department|school|lab|laboratory)\b"
)
NOT_FOUND = "Not found"

# ---- fixed values: markdown sections -------------------------------------------------------
# In this order: the first keyword contained in a heading decides.
CANONICAL_SECTIONS = {
    "abstract": "abstract",
    "introduction": "introduction",
    "related work": "introduction",
    "background": "introduction",
    "method": "methodology",
    "methodology": "methodology",
    "approach": "methodology",
    "model": "methodology",
    "experiment": "results",
    "result": "results",
    "evaluation": "results",
    "discussion": "results",
    "conclusion": "conclusion",
    "concluding": "conclusion",
    "limitation": "limitations",
    "future": "future_work",
}

# ---- fixed values: titles and author lines -----------------------------------------------
TITLE_PROSE = (
    r"(?i)(?:^|\b)(pushing the|state[- ]of[- ]the[- ]art with\s+\w+|chatbot state|"
    r"our approach in|in this paper we|recent advances in a survey|an overview of|"
    r"^(pushing|achieving|improving|exploring|leveraging|harnessing)\b)"
)
TITLE_REJECTS = [
    r"(?i)^(table|figure|fig\.?|appendix)\s*\d+[:.\s-]",
    r"(?i)^(results|ablation|discussion|conclusion|references)\b",
    r"(?i)^https?://",
]
LINK_MARKS = ["doi.org", "http://", "https://", "arxiv.org", "@"]
AUTHOR_REJECT_MARKS = [
    "doi", "http", "arxiv", "@", "doi.org",
    "abstract", "introduction", "conclusion", "table ", "figure ", "appendix",
]
AUTHOR_REJECTS = (
    r"(?i)\b(permission|license|grant|copyright|rights reserved|attribution|"
    r"hereby|reproduce|commercial|redistribution|provided that|licen[cs]e|"
    r"all rights|published by|proceedings of|conference on|acm|ieee|"
    r"this work|this paper|we present|we propose|abstract|introduction|doi)\b"
)
AFFILIATION_ONLY = (
    r"(?i)^(?:university|dept|department|institute|school|lab|laboratory|center|centre|"
    r"google|microsoft|meta|openai|deepmind|amazon|apple|facebook|ibm|nvidia|"
    r"research|corporation|inc\.|ltd\.|llc)\b"
)
EMAIL_ONLY = r"^[\w.+%-]+@[\w.-]+\.[a-zA-Z]{2,}$"
INSTITUTION_WORDS = [
    "University", "Department", "Institute", "School", "Center", "Laboratory", "Research", "Google",
    "Microsoft", "Meta", "Openai", "Deepmind", "Amazon", "Nvidia", "Facebook",
]
TITLE_SKIP_PREFIXES = [
    "we ", "this paper", "in this work", "in this paper", "abstract", "introduction", "here we",
]
TITLE_SKIP_CONTAINS = [
    "accuracy", "table", "figure", "baseline", "performance", "evaluate", "experiment", "section", "appendix",
]

# ---- fixed values: retrieval -----------------------------------------------------------------
# A token starts and ends with a word character; inside it may hold - . ( ).
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\-.()]*[\p{L}\p{N}_])?"
BM25_K1 = 1.5
BM25_B = 0.75
RRF_K = 60
BOOST_TYPE = 0.15
BOOST_SUBSTRING = 0.05
BOOST_NUMBER = 0.25
BOOST_PRIORITY = 0.02
ELEMENT_TYPES = ["equation", "table", "figure"]
RERANK_BASE, RERANK_NEW, RERANK_META = 0.4, 0.6, 0.3
NGRAM_UNI, NGRAM_BI, GRAPH_BONUS = 0.6, 0.4, 0.05
VECTOR_SOURCE, GRAPH_SOURCE = "Vector Chunk", "Knowledge Graph"
VECTOR_HEADER = "### 📄 Vector Evidence (semantic passages)"
GRAPH_HEADER = "\n### 🔗 Knowledge-Graph Facts (structured triplets)"
QUERY_STOP_WORDS = [
    "what", "is", "are", "the", "a", "an", "of", "in", "on", "for", "and", "or", "to", "me",
    "show", "explain", "why", "how", "does", "do", "did", "all", "this", "that", "paper", "document",
    "mentioned", "model", "task", "tasks", "with", "from", "about", "which", "best",
]
FOCUS_PREFIXES = ["what is ", "what are ", "who is ", "who are ", "explain ", "define "]
SUMMARY_WORDS = ["main findings", "summarize", "summary", "contributions", "top contributions"]
LIMITATION_WORDS = ["limitations", "future work", "open problems", "weaknesses"]
EXPLANATION_WORDS = ["explain", "why", "how", "interpret", "meaning"]
DEFINITION_STARTS = ["what is ", "what are "]
DEFINITION_WORDS = ["defined", "definition"]
SUMMARY_VARIANTS = ["main findings contributions results conclusion", "abstract key results contributions"]
LIMITATION_VARIANTS = ["limitations future work discussion conclusion", "future work limitations open problems"]
NOT_CONTAINED = "The document does not contain this information."
EQUATION_WORDS = ["equation", "formula", "derivation", "derive"]
TABLE_WORDS = [
    "table", "result", "results", "score", "scores", "benchmark", "performance", "dataset", "evaluation",
    "baseline", "compare", "comparison", "ablation",
]
FIGURE_QUERY_WORDS = ["figure", "diagram", "architecture", "overview", "pipeline", "framework", "model", "system"]
DOMAIN_TERMS = [
    "rag token", "rag-token", "p_rag-token", "p rag-token", "p_rag_token", "ragtoken",
    "top-k", "top k", "p_eta", "p_theta", "pη", "pθ",
]
STRONG_DOMAIN_TERMS = ["p_rag-token", "rag-token(y|x", "rag-token (y|x"]
# A metric word shared by question and table counts 20 as a data word and 10 as a metric word.
METRIC_WORDS = [
    "score", "scores", "accuracy", "precision", "recall", "f1", "performance", "results", "benchmark",
    "evaluation", "ablation", "baseline", "error", "loss",
]
ARCHITECTURE_QUERY_WORDS = ["architecture", "overview", "pipeline", "model", "system", "diagram"]
ARCHITECTURE_TEXT_WORDS = ["architecture", "overview", "pipeline", "model", "system", "framework"]
EQUATION_SENTENCE = (
    " is the relevant formula. It is one of the key mathematical definitions used in the paper."
)
RESULT_WORDS = ["result", "results", "score", "benchmark", "dataset", "performance", "table", "compare", "comparison"]
DIAGRAM_WORDS = ["figure", "diagram", "architecture", "overview", "pipeline", "model"]

# ---- fixed values: question classes -------------------------------------------------------------
CROSS_REFERENCE_PATTERNS = [r"relation.*between", r"how.*relate", r"connection.*between", r"link.*between"]
COMPARISON_PATTERNS = [
    r"compare\s+(equation|table|figure)s?\s+(\d+)\s+(?:and|with)\s+(\d+)",
    r"difference\s+between\s+(equation|table|figure)s?\s+(\d+)\s+and\s+(\d+)",
]
LIST_ALL_PATTERNS = [
    r"(?:show|list|display|extract)\s+all\s+(equation|table|figure)s?",
    r"how many\s+(equation|table|figure)s?",
    r"all\s+(?:the\s+)?(equation|table|figure)s?",
]
SPECIFIC_PATTERNS = {
    "equation": [
        r"\bequation\s+(\d+)\b", r"\beq\.?\s+(\d+)\b", r"\bformula\s+(\d+)\b",
        r"explain.*equation\s+(\d+)", r"show.*equation\s+(\d+)", r"what.*equation\s+(\d+)",
    ],
    "table": [r"\btable\s+(\d+)\b", r"\btbl\.?\s+(\d+)\b", r"show.*table\s+(\d+)"],
    "figure": [r"\bfigure\s+(\d+)\b", r"\bfig\.?\s+(\d+)\b", r"show.*figure\s+(\d+)"],
}
TYPE_KEYWORDS = {
    "equation": ["equation", "formula", "mathematical", "calculation", "expression", "variable", "function", "latex"],
    "table": ["table", "data", "results", "statistics", "values", "columns", "rows", "dataset", "comparison"],
    "figure": ["figure", "image", "diagram", "graph", "plot", "chart", "illustration", "visualization", "picture"],
}
SEED_STOP_WORDS = [
    "what", "which", "where", "when", "how", "why", "who", "does", "did",
    "the", "and", "but", "for", "are", "was", "were", "with", "that",
    "this", "from", "have", "has", "been", "its", "they", "their",
    "about", "into", "over", "more", "some", "than", "then", "each",
    "both", "also", "can", "could", "would", "should", "not", "any",
    "all", "other", "used", "use", "using", "give", "tell", "explain",
    "describe", "list", "show", "find", "get", "make", "take",
]
KEYWORD_QUERY_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "by", "about", "of",
    "this", "that", "it", "is", "are", "was", "were", "be", "been",
]
METADATA_WORDS = [
    "title", "author", "who wrote", "written by", "published",
    "year", "date", "when", "abstract", "summary",
    "affiliation", "university", "institution", "conference",
]
ANALYSIS_WORDS = ["analyze", "compare", "difference"]
MODE_EXPLANATION_WORDS = ["explain", "why", "how"]
COUNT_WORDS = ["how many", "number of", "count"]
LIST_PHRASES = {
    "equation": [
        "show all equations", "show all equation", "list equations", "list all equations",
        "show equations", "what equations are", "all equations", "all equation",
        "equations mentioned", "extract all equations", "extract every mathematical formula",
        "every mathematical formula", "all mathematical formulas", "show me all equation",
        "show me all equations", "show every equation",
    ],
    "table": [
        "show all tables", "show all table", "list tables", "list all tables",
        "show tables", "all tables", "all table", "extract all tables", "show every table",
    ],
    "figure": [
        "show all figures", "show all figure", "list figures", "list all figures",
        "show figures", "all figures", "all figure", "extract all figures", "show every figure",
    ],
}
ANSWER_EQUATION_WORDS = ["equation", "formula", "math", "definition", "derive", "derivation"]
ANSWER_EQUATION_NUMBER = r"\b(?:equation|eq\.?)\s*[(\[]?\s*\d+\s*[)\]]?"

# ---- fixed values: question expansion --------------------------------------------------------------
QUESTION_TEMPLATES = ["What is {}?", "Explain {}", "Define {}", "{} meaning", "Show information about {}"]
CONTEXT_TEMPLATES = ["{} in the document", "{} according to the paper", "{} details", "{} explanation"]
GENERAL_TEMPLATES = ["general information about {}", "{} overview", "background on {}"]
QUESTION_SWAPS = [("what", "how"), ("how", "what"), ("why", "what"), ("explain", "describe")]
QUESTION_STARTS = ["what", "how", "why", "when", "where", "who", "which"]
SYNONYMS = {
    "equation": ["formula", "expression", "mathematical relation"],
    "table": ["data", "results", "values", "numbers"],
    "figure": ["image", "diagram", "illustration", "graph", "plot"],
    "model": ["architecture", "framework", "system", "approach"],
    "method": ["technique", "approach", "strategy", "algorithm"],
    "result": ["outcome", "finding", "conclusion", "performance"],
    "compare": ["difference", "contrast", "versus", "comparison"],
    "rag": ["retrieval augmented generation", "retrieval-based generation"],
    "transformer": ["attention mechanism", "self-attention model"],
    "embedding": ["vector representation", "dense vector"],
}
CONCEPT_STOP_WORDS = [
    "what", "how", "why", "when", "where", "who", "which",
    "is", "are", "the", "a", "an", "of", "in", "to", "for",
    "show", "explain", "tell", "me", "about",
]

# ---- fixed values: question decomposition -----------------------------------------------------------
COMPARATIVE_RULES = [
    (r"compare\s+(.+?)\s+(?:and|with|to)\s+(.+?)(?:\s|$)", "comparison"),
    (r"difference\s+(?:between\s+)?(.+?)\s+and\s+(.+?)(?:\s|$)", "difference"),
    (r"relation(?:ship)?\s+between\s+(.+?)\s+and\s+(.+?)(?:\s|$)", "relation"),
    (r"(.+?)\s+versus\s+(.+?)(?:\s|$)", "versus"),
    (r"(.+?)\s+vs\.?\s+(.+?)(?:\s|$)", "versus"),
    (r"how\s+(?:does|do)\s+(.+?)\s+(?:differ|compare)\s+(?:from|to|with)\s+(.+?)(?:\s|$)", "comparison"),
]
REFERENCE_RULES = [
    (r"(?:table|tbl)\s+(\d+)\s+and\s+(?:equation|eq)\s+(\d+)", "table_equation"),
    (r"(?:figure|fig)\s+(\d+)\s+and\s+(?:table|tbl)\s+(\d+)", "figure_table"),
    (r"(?:equation|eq)\s+(\d+)\s+and\s+(?:equation|eq)\s+(\d+)", "equation_equation"),
    (r"results?\s+(?:of|from)\s+(?:table|tbl)\s+(\d+)()", "table_results"),
    (r"(?:using|based on)\s+(?:equation|eq)\s+(\d+)()", "equation_based"),
]
SEQUENTIAL_RULES = [
    (r"(.+?),\s*then\s+(.+)", "sequential"),
    (r"first\s+(.+?),\s*(?:then|and then|next)\s+(.+)", "sequential"),
    (r"(.+?)\s+and\s+also\s+(.+)", "additive"),
    (r"(.+?)\s+as\s+well\s+as\s+(.+)", "additive"),
]
# Sub-questions by class: text with {1} {2} for the matched parts and {q} for the question, type, priority, dependencies.
SUB_QUESTIONS = {
    "compare": [("What is {1}?", "retrieval", 1, []), ("What is {2}?", "retrieval", 1, []), ("Compare {1} and {2}", "synthesis", 2, [0, 1])],
    "table_equation": [
        ("Show table {1}", "table_retrieval", 1, []), ("Show equation {2}", "equation_retrieval", 1, []),
        ("Relate the results from table {1} to equation {2}", "synthesis", 2, [0, 1]),
    ],
    "figure_table": [
        ("Show figure {1}", "figure_retrieval", 1, []), ("Show table {2}", "table_retrieval", 1, []),
        ("How do figure {1} and table {2} relate?", "synthesis", 2, [0, 1]),
    ],
    "equation_equation": [
        ("Show equation {1}", "equation_retrieval", 1, []), ("Show equation {2}", "equation_retrieval", 1, []),
        ("What is the relationship between equation {1} and equation {2}?", "synthesis", 2, [0, 1]),
    ],
    "table_results": [("Show table {1} with all details", "table_retrieval", 1, [])],
    "equation_based": [("Show equation {1}", "equation_retrieval", 1, []), ("{q}", "synthesis", 2, [0])],
    "sequence": [("{1}", "retrieval", 1, []), ("{2}", "retrieval", 2, [0])],
    "simple": [("{q}", "simple", 1, [])],
}
FUSION_TYPES = ["comparison", "difference", "relation", "synthesis"]

# ---- fixed values: papers ------------------------------------------------------------------------
PAPER_STOP_WORDS = [
    "the", "a", "an", "in", "of", "and", "or", "for", "to", "with", "on", "is", "are", "was",
    "were", "be", "been", "by", "as", "at", "from", "that", "this", "which", "we", "our",
    "their", "has", "have", "had", "using", "based", "via", "through", "can", "also",
]
TAG_SKIP_WORDS = ["that", "with", "this", "from", "have", "been", "they", "which", "their", "also", "such"]
HYBRID_WEIGHTS = (0.40, 0.20, 0.25, 0.15)
TREND_RISING, TREND_DECLINING, TREND_STABLE = "Rising (active research area)", "Declining", "Stable"

# ---- fixed values: metrics and quotas ----------------------------------------------------------------
REQUEST_BUCKETS = [0.1, 0.5, 1, 2, 5, 10, 30, 60, 120, 300]
MODEL_BUCKETS = [0.5, 1, 2, 5, 10, 30, 60]
QUOTA = {"requests_minute": 30, "tokens_minute": 14400, "tokens_day": 600_000, "tokens_month": 15_000_000}
QUOTA_MARGIN = 0.10

# ---- fixed values: answer checks -----------------------------------------------------------------------
HEDGES = [
    "probably", "might be", "possibly", "perhaps", "maybe",
    "could be", "seems to be", "appears to be", "likely",
    "i think", "i believe", "i assume", "presumably",
]
LIST_MARKS = ["1.", "2.", "-", "*", "•"]
CONFIDENCE = {"refs": 0.8, "types": 0.7, "unsupported": 0.6, "complete": 0.9, "repetition": 0.95, "relevance": 0.4}
LEVELS = {"strict": (0.95, 0, 0.60), "moderate": (0.80, 2, 0.45), "lenient": (0.60, 5, 0.45)}
BROKEN_ANSWER = [r"(?i)Short Summary\s+Short", r"(?i)Explanation\s+Short", r"(?i)p\s*R\s*A\s*G", r"(?i)⚠️ Error generating response"]
REFUSALS = [
    "cannot find", "does not contain", "not present", "not available", "no information", "not mentioned",
    "i cannot", "the document does not",
]
DENIALS = ["cannot find", "does not contain", "not present", "not available"]

# ---- fixed values: merged sections -------------------------------------------------------------------------
GENERIC_OPENERS = ["the paper", "this paper", "the study", "the research", "the authors", "in this", "this work"]
FIGURE_SECTIONS = ["results", "abstract", "conclusion", "methodology", "introduction"]
