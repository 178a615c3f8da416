"""Word lists, tables and patterns that results depend on. All are fixed values, stated in natural order."""

from __future__ import annotations

# Keywords of the broad recall query.
PRIMARY = (
    "Large Language Model", "LLM", "Language Model", "Neural Language Model", "RLHF",
    "Reinforcement Learning from Human Feedback", "Fine-tuning", "Instruction Tuning",
    "Pre-trained Language Model", "PLM",
)
OPEN_MODELS = (
    "LLaMA", "Llama 2", "Llama 3", "Qwen", "Qwen2", "Mistral", "Mixtral", "DeepSeek", "DeepSeek-V2",
    "Falcon", "Yi", "Phi", "Gemma", "OLMo",
)
CLOSED_MODELS = ("GPT", "GPT-4", "ChatGPT", "Gemini", "PaLM", "Bard", "Claude", "Constitutional AI")
TECHNIQUES = (
    "Prompt Engineering", "Prompting", "RAG", "Retrieval-Augmented Generation", "PEFT", "LoRA", "QLoRA",
    "Adapter", "Quantization", "Pruning", "Chain-of-Thought", "CoT", "Reasoning", "In-Context Learning",
    "ICL", "Alignment", "Safety", "Scaling Law", "Mixture of Experts", "MoE",
)
REFINED = (
    "Self-Attention", "LLM Agent", "Language Agent", "Text Embedding", "Vision-Language Model", "VLM",
    "Tool Use", "Function Calling",
)
POSITIVE = PRIMARY + OPEN_MODELS + CLOSED_MODELS + TECHNIQUES + REFINED
CONTEXT_DEPENDENT = ("GNN", "Graph Neural Network", "Contrastive Learning", "Self-Supervised Learning")
CATEGORIES = ("cs.CL", "cs.LG", "cs.AI", "stat.ML")

# Substrings that reject a paper.
NEGATIVE = (
    "Robot", "Robotics", "Game", "Gaming", "Image Classification", "Object Detection", "Speech Recognition",
    "MRI", "CT scan", "Ultrasound", "Brain Tumor Segmentation", "Retinal Imaging",
    "Medical Image Segmentation", "Radiology", "Cardiac Segmentation", "Glioma Segmentation", "EEG", "ECG",
    "Radar Signal", "Speech Emotion Recognition", "Audio Source Separation", "Sleep Staging",
    "Vortex-Induced Vibration", "LiDAR", "Point Cloud", "Depth Estimation", "3D Reconstruction",
    "Pose Estimation", "Image Segmentation", "Semantic Segmentation", "UAV", "Unmanned Aerial Vehicle",
    "Trajectory Prediction", "Autonomous Vehicle", "Path Planning", "Multi-Agent Pathfinding",
    "Motion Planning", "Policy Learning", "Markov Decision Process", "MDP", "Reward Shaping", "Q-Learning",
    "Multi-Agent Reinforcement Learning", "MARL", "Node Classification", "Community Detection",
    "Graph Clustering", "Time Series Forecasting", "Traffic Prediction", "Sensor Data",
    "Precipitation Forecasting", "Weather Forecasting", "Archaeology", "Aviation Safety",
    "Molecular Generation", "Chemical Structure", "Marine Riser", "Tyre Energy", "Formula One",
    "Latent Dirichlet Allocation", "LDA Topic Model", "Lemmatization", "Word Sense Disambiguation",
    "Hierarchical Clustering", "Federated Learning", "Outlier Detection", "Anomaly Detection",
    "Malware Detection", "Traffic Signal Control", "Maritime", "Ship Identification", "Furnace",
    "Vehicle Detection",
)

# Substrings that clear a paper.
STRONG = (
    "language model", "llm", "large language", "gpt", "chatgpt", "llama", "instruction tuning", "rlhf",
    "prompt", "in-context learning", "transformer architecture", "self-attention mechanism",
    "mixture-of-experts", "mixture of experts", "moe model", "model compression", "knowledge distillation",
    "model pruning", "ai-generated text", "machine-generated text", "text detection",
    "retrieval-augmented generation", "retrieval augmented", "rag", "foundation model",
    "pre-trained model", "pretrained model", "fine-tuning", "fine tuning", "model merging", "task vector",
    "task arithmetic", "test-time compute", "generative ai", "genai", "text generation",
    "natural language generation", "nlg", "bert", "t5", "bart", "slot and intent detection",
    "natural language understanding", "nlu", "text classification", "sentiment analysis",
    "named entity recognition", "ner", "question answering", "machine translation",
    "neural machine translation", "nmt",
)

# Topics in order of precedence, with their substrings.
TOPICS = {
    "llm_pretraining": (
        "pretraining", "pre-training", "pre-trained", "foundation model", "scaling", "large language model",
        "llm training",
    ),
    "reasoning_alignment": (
        "reasoning", "chain-of-thought", "cot", "alignment", "rlhf",
        "reinforcement learning from human feedback", "safety",
    ),
    "multimodal": (
        "multimodal", "vision-language", "vlm", "image-text", "visual question answering", "vqa",
    ),
    "retrieval_rag": (
        "retrieval", "rag", "retrieval-augmented", "knowledge base", "information retrieval",
        "dense retrieval",
    ),
    "architecture": (
        "transformer", "attention", "architecture", "moe", "mixture of experts", "sparse", "efficient",
    ),
    "optimization": (
        "quantization", "pruning", "distillation", "compression", "efficient", "lora", "peft",
        "fine-tuning",
    ),
    "evaluation": ("benchmark", "evaluation", "metric", "leaderboard", "assessment", "capability"),
}
OTHER_TOPIC = "other"

# Target shares of topics.
TARGET_SHARES = {
    "llm_pretraining": 0.20,
    "reasoning_alignment": 0.20,
    "multimodal": 0.15,
    "retrieval_rag": 0.15,
    "architecture": 0.10,
    "optimization": 0.10,
    "evaluation": 0.10,
}

# Weights of the final score, months of recency decay.
SCORE_WEIGHTS = {"citation": 0.40, "recency": 0.30, "semantic": 0.20, "stratified": 0.10}
RECENCY_MONTHS = 6.0

# Technical terms of the query classifier.
TECHNICAL = (
    "transformer", "bert", "gpt", "llm", "lstm", "cnn", "rnn", "gan", "vae", "autoencoder", "diffusion",
    "vit", "clip", "dalle", "deepseek", "llama", "mistral", "gemini", "claude", "chatgpt", "t5", "bart",
    "roberta", "xlnet", "albert", "electra", "attention", "self-attention", "multi-head", "embedding",
    "tokenization", "fine-tuning", "pretraining", "transfer learning", "few-shot", "zero-shot",
    "in-context", "prompt", "chain-of-thought", "cot", "rag", "retrieval", "rlhf", "dpo", "ppo", "grpo",
    "reinforcement learning", "quantization", "pruning", "distillation", "lora", "qlora", "peft",
    "multimodal", "vision-language", "text-to-image", "image-to-text", "encoder", "decoder",
    "sequence-to-sequence", "seq2seq", "cross-entropy", "softmax", "layer normalization", "dropout",
    "positional encoding", "sinusoidal", "rotary", "alibi", "glue", "superglue", "squad", "mmlu",
    "hellaswag", "arc", "humaneval", "mbpp", "gsm8k", "math", "big-bench", "classification", "regression",
    "generation", "summarization", "translation", "qa", "question answering", "ner", "entity recognition",
    "sentiment analysis", "semantic similarity", "entailment",
)
QUESTION_WORDS = ("how", "what", "why", "when", "where", "which", "who", "can", "does", "is", "are")

# Patterns of conceptual language.
CONCEPTUAL = (
    r"\bmaking\s+\w+\s+better\b",
    r"\bimproving\s+\w+\b",
    r"\bteaching\s+(machines?|computers?|models?)\b",
    r"\blearning\s+from\s+\w+\b",
    r"\bunderstanding\s+\w+\b",
    r"\bpredicting\s+\w+\b",
    r"\bstep.by.step\b",
    r"\bthink(ing)?\s+(through|step)\b",
    r"\breward\s+signal\b",
    r"\bhuman\s+(feedback|examples?|demonstrations?)\b",
    r"\bwithout\s+(human|examples?|labels?)\b",
    r"\bhow\s+does\s+\w+\s+enable\b",
    r"\bhow\s+do\s+\w+\s+handle\b",
    r"\bhow\s+can\s+\w+\s+(improve|enhance|achieve)\b",
    r"\bwhat\s+are\s+the\s+(limitations?|challenges?|benefits?)\b",
    r"\bwhy\s+do\s+\w+\s+(fail|struggle|succeed)\b",
    r"\bwhat\s+makes\s+\w+\s+(work|effective|possible)\b",
    r"\benabling\s+\w+\b",
    r"\bachieving\s+\w+\b",
    r"\bovercoming\s+\w+\b",
    r"\baddressing\s+\w+\b",
)

# Rank-fusion presets (dense, sparse, late-interaction weights).
RRF_PRESETS = {
    "default": (0.4, 0.3, 0.3),
    "conceptual": (0.6, 0.2, 0.2),
    "keyword": (0.3, 0.5, 0.2),
    "balanced": (0.5, 0.25, 0.25),
    "dense_only": (1.0, 0.0, 0.0),
}
RRF_K = 60
PRESET_OF_TYPE = {"keyword": "keyword", "conceptual": "conceptual", "natural": "balanced"}
#: Candidates fetched per query type (dense, sparse).
FETCH_SIZES = {"conceptual": (100, 50), "keyword": (30, 80), "natural": (50, 50)}

# Titles of sections that are left out.
EXCLUDED_SECTIONS = (
    r"references?", r"bibliography", r"citations?", r"works?\s+cited", r"acknowledgm?ents?",
    r"acknowledgements?", r"author\s+contributions?", r"contributions?", r"author\s+information",
    r"authors?", r"ethics\s+statement", r"ethical\s+considerations?", r"broader\s+impact",
    r"societal\s+impact", r"funding", r"funding\s+statement", r"financial\s+support",
    r"competing\s+interests?", r"conflict\s+of\s+interest", r"declaration\s+of\s+interests?",
    r"disclosures?", r"supplementary\s+materials?", r"supplemental\s+materials?", r"appendix",
    r"appendices", r"data\s+availability", r"code\s+availability", r"reproducibility",
)

# Importance of sections by title.
SECTION_IMPORTANCE = {
    "abstract": 1.0, "introduction": 0.9, "method": 0.85, "methodology": 0.85, "methods": 0.85,
    "approach": 0.85, "model": 0.85, "architecture": 0.85, "experiments": 0.8, "experimental setup": 0.75,
    "results": 0.85, "evaluation": 0.8, "analysis": 0.8, "discussion": 0.75, "conclusion": 0.7,
    "conclusions": 0.7, "related work": 0.6, "background": 0.65, "preliminaries": 0.6, "limitations": 0.7,
    "future work": 0.5,
}
DEFAULT_IMPORTANCE = 0.7

# Markup that is removed with what it holds.
DROP_WITH_CONTENT = (
    "cite", "citep", "citet", "citeauthor", "citeyear", "ref", "eqref", "pageref", "autoref", "Cref", "cref",
    "label", "footnote", "thanks", "marginpar", "includegraphics", "input", "include",
)
# Markup that is removed alone.
DROP_ALONE = (
    r"noindent", r"indent", r"par\b", r"newline", r"linebreak", r"pagebreak", r"newpage", r"clearpage",
    r"hfill", r"vfill", r"hspace\{[^}]*\}", r"vspace\{[^}]*\}", r"smallskip", r"medskip", r"bigskip",
    r"centering", r"raggedright", r"raggedleft",
)
# Markup that gives way to what it holds (patterns before the argument).
KEEP_CONTENT = (
    r"textbf", r"textit", r"emph", r"texttt", r"textrm", r"textsf", r"textsc", r"underline",
    r"textcolor\{[^}]*\}", r"colorbox\{[^}]*\}", r"mbox", r"hbox", r"vbox", r"fbox",
    r"makebox(?:\[[^\]]*\])?", r"parbox(?:\[[^\]]*\])?\{[^}]*\}", r"raisebox\{[^}]*\}(?:\[[^\]]*\])?",
    r"scalebox\{[^}]*\}", r"resizebox\{[^}]*\}\{[^}]*\}", r"rotatebox\{[^}]*\}", r"phantom", r"hphantom",
    r"vphantom",
)
# Literal replacements, in order. The escapes have two backslashes each.
SPECIAL_CHARS = (
    ("\\\\%", "%"), ("\\\\&", "&"), ("\\\\#", "#"), ("\\\\_", "_"), ("\\\\$", "$"), ("\\\\{", "{"),
    ("\\\\}", "}"), ("\\\\textbackslash", "\\"), ("\\\\textasciitilde", "~"), ("\\\\textasciicircum", "^"),
    ("\\\\ldots", "..."), ("\\\\dots", "..."), ("\\\\cdots", "..."), ("---", "—"), ("--", "–"), ("``", '"'),
    ("''", '"'), ("`", "'"), ("~", " "),
)
# Environments without running text.
NOISY_ENVIRONMENTS = (
    "tikzpicture", "pgfpicture", "pspicture", "algorithm", "algorithmic", "algorithmicx", "lstlisting",
    "minted", "verbatim", "figure", "figure*", "wrapfigure", "table", "table*",
)
# States of a paper.
STATUSES = ("pending", "collected", "parsed", "embedded", "failed")

# Rules that both the column functions (quarry.functions.text) and the parsers (quarry.operators.parsing) apply, in order: pattern, and what takes
# its place ($1 is the first group). Fixed values.
_BRACED = r"\{[^}]*\}"
COMMANDS = (
    *((rf"\\{c}" + (r"(?:\[[^\]]*\])?" if c == "includegraphics" else "") + _BRACED, "") for c in DROP_WITH_CONTENT),
    *((rf"\\{c}", "") for c in DROP_ALONE),
    *((rf"\\{c}\{{([^}}]*)\}}", "$1") for c in KEEP_CONTENT),
    *((r"\\[a-zA-Z]+(?:\[[^\]]*\])?\{([^{}]*)\}", "$1") for _ in range(3)),  # nested up to three deep
    (r"\\[a-zA-Z]+(?:\[[^\]]*\])?(?=\s|$|[^a-zA-Z{])", ""),
)
SIGNS = (
    (r"``([^']+)''", '"$1"'), (r"`([^']+)'", "'$1'"), (r"\$([^$]+)\$", "$1"), (r"\\\(([^)]+)\\\)", "$1"), (r"\{\s*\}", ""), (r"[{}]", ""),
    (r"[ \t]+", " "), (r"\n{3,}", "\n\n"), (r"(?m)^\s+", ""),
)
EQUATION_MARKS = ((r"\\(?:begin|end)\{(?:equation|align|gather|multline)\*?\}", ""), (r"\\label\{[^}]*\}", ""), (r"\s+", " "))
HEADING_MARKS = ((r"^[\d.]+\s*", ""), (r"[.:;,]+$", ""))
TITLE_COMMENT = ((r"(?<!\\)%[^\n]*\n?", ""), (r"\s+", " "))
TITLE_ENDS = ((r"^[:\-–—\s]+", ""), (r"[:\-–—\s]+$", ""))

# The built-in evaluation set: question, relevant papers, category.
EVALUATION = (
    ("What is RLHF and how does reinforcement learning from human feedback improve language models?", ("2501.01031v3", "2501.01336v1"), "alignment"),
    ("How does retrieval augmented generation (RAG) improve LLM responses?", ("2501.00879v3", "2501.01031v3"), "rag"),
    ("What techniques are used for multi-tool reasoning in LLMs?", ("2501.01290v1", "2501.00830v2"), "reasoning"),
    ("How do multimodal large language models process both text and images?", ("2501.00750v2", "2501.01645v3"), "multimodal"),
    ("How are LLM agents used for autonomous problem solving?", ("2501.01205v1", "2501.00750v2"), "agents"),
    ("What benchmarks are used to evaluate LLM capabilities?", ("2501.01243v3", "2501.01290v1"), "evaluation"),
    ("How do attention mechanisms work in transformer models?", ("2501.00759v3", "2501.01073v2"), "architecture"),
    ("What methods improve trustworthiness and robustness of RAG systems?", ("2501.00879v3", "2501.00888v1"), "rag"),
)

# Patterns of floats (KIND: figure or table), images, tabulars, and the rules that a row may start with.
FLOAT = r"\\begin\{KIND\*?\}(.*?)\\end\{KIND\*?\}"
IMAGE = r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}"
TABULAR = r"\\begin\{tabular\}(?:\{[^}]*\})?(.*?)\\end\{tabular\}"
RULES = ("\\hline", "\\cline")
