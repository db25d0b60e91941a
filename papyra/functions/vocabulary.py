"""Word lists, tables and patterns that results depend on. All can be replaced by arguments."""

from __future__ import annotations

CATEGORIES = {
    "cs.AI": "Artificial Intelligence",
    "cs.LG": "Machine Learning",
    "cs.CL": "Computation and Language",
    "cs.CV": "Computer Vision and Pattern Recognition",
    "cs.NE": "Neural and Evolutionary Computing",
    "stat.ML": "Machine Learning (Statistics)",
    "cs.IR": "Information Retrieval",
    "cs.RO": "Robotics",
    "cs.HC": "Human-Computer Interaction",
    "cs.CR": "Cryptography and Security",
}

#: Words left out of keywords.
STOP_WORDS = (
    "the", "is", "at", "which", "on", "a", "an", "as", "are", "was", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may",
    "might", "must", "can", "of", "in", "to", "for", "with", "by", "from", "about", "what", "how", "why", "where", "when",
)

#: Terms added to a question that holds the phrase.
DOMAIN_TERMS = {
    "neural network": ("deep learning", "artificial neural network", "multilayer perceptron", "neural model"),
    "transformer": ("attention mechanism", "self-attention", "multi-head attention", "BERT", "GPT"),
    "deep learning": ("neural network", "backpropagation", "gradient descent", "convolutional neural network"),
    "attention": ("self-attention", "multi-head attention", "attention mechanism", "attention weights"),
    "embeddings": ("word embeddings", "sentence embeddings", "vector representations", "latent representations"),
    "cnn": ("convolutional neural network", "convolution", "pooling", "feature maps"),
    "object detection": ("YOLO", "R-CNN", "bounding box", "computer vision"),
    "image classification": ("computer vision", "feature extraction", "visual recognition"),
    "nlp": ("natural language processing", "text processing", "language model", "computational linguistics"),
    "language model": ("LLM", "large language model", "GPT", "BERT", "transformer"),
    "tokenization": ("text preprocessing", "word segmentation", "subword units"),
    "evaluation": ("assessment", "validation", "testing", "performance measurement", "metrics"),
    "methodology": ("approach", "method", "technique", "framework", "algorithm"),
    "dataset": ("data", "corpus", "benchmark", "training data", "test set"),
    "baseline": ("benchmark", "comparison method", "reference model", "state-of-the-art"),
    "accuracy": ("precision", "recall", "F1-score", "performance metrics"),
    "loss function": ("objective function", "cost function", "optimization objective"),
    "optimization": ("gradient descent", "SGD", "Adam", "learning rate", "training"),
    "regularization": ("dropout", "weight decay", "batch normalization", "overfitting prevention"),
    "hyperparameters": ("learning rate", "batch size", "model parameters", "tuning"),
}

#: Terms added to a question that has the word.
SYNONYMS = {
    "improve": ("enhance", "boost", "increase", "optimize", "better"),
    "method": ("approach", "technique", "algorithm", "strategy", "procedure"),
    "result": ("outcome", "finding", "conclusion", "performance", "achievement"),
    "analyze": ("examine", "investigate", "study", "evaluate", "assess"),
    "propose": ("present", "introduce", "suggest", "offer", "develop"),
    "novel": ("new", "innovative", "original", "creative", "unique"),
    "effective": ("efficient", "successful", "powerful", "robust", "reliable"),
    "problem": ("issue", "challenge", "task", "question", "difficulty"),
    "solution": ("answer", "resolution", "approach", "method", "technique"),
    "comparison": ("comparison", "evaluation", "analysis", "assessment", "study"),
}

#: Phrases brought to one form, in this order.
PHRASES = (
    (r"\bstate of the art\b", "state-of-the-art"),
    (r"\bstate-of-art\b", "state-of-the-art"),
    (r"\bcutting edge\b", "cutting-edge"),
    (r"\breal world\b", "real-world"),
    (r"\bdata set\b", "dataset"),
    (r"\bdata base\b", "database"),
    (r"\bmachine learning\b", "machine learning"),
    (r"\bartificial intelligence\b", "AI"),
    (r"\bnatural language processing\b", "NLP"),
    (r"\bcomputer vision\b", "computer vision"),
)

#: Terms of the second form of expansion, by concept contained and by keyword.
CONCEPTS = {
    "machine learning": ("ML", "artificial intelligence", "AI", "neural networks", "deep learning"),
    "natural language processing": ("NLP", "text mining", "computational linguistics", "language modeling"),
    "computer vision": ("CV", "image processing", "visual recognition", "pattern recognition"),
    "deep learning": ("neural networks", "CNN", "RNN", "transformer", "attention mechanism"),
}
KEYWORD_SYNONYMS = {
    "method": ("approach", "technique", "algorithm"),
    "result": ("finding", "outcome", "conclusion"),
    "model": ("framework", "architecture", "system"),
    "performance": ("accuracy", "effectiveness", "efficiency"),
}

#: Patterns of question types in order of trial; none found means factual.
QUESTION_TYPES = (
    ("factual", r"\bwhat is\b|\bwho is\b|\bwhen did\b|\bwhere is\b|\bhow many\b"),
    ("analytical", r"\bwhy\b|\bhow does\b|\bexplain\b|\banalyze\b"),
    ("comparative", r"\bcompare\b|\bdifference\b|\bversus\b|\bbetter\b|\bsimilar\b"),
    ("summary", r"\bsummarize\b|\boverview\b|\bmain points\b|\bkey findings\b"),
)
TYPE_WEIGHTS = {"factual": 1.0, "analytical": 1.2, "comparative": 1.1, "summary": 0.9}
#: Words inside a question that tell its intent, in order of trial; none found means find.
INTENTS = (("compare", ("compare", "difference", "versus", "vs")), ("explain", ("explain", "why", "how")), ("summarize", ("summarize", "overview", "main")))
TECHNICAL = ("bert", "gpt", "transformer", "cnn", "rnn", "lstm")

#: Identifiers, years and venues in citations.
DOI = r"(?i)(?:doi:?[ \t\n]*|https?://(?:dx\.)?doi\.org/)(10\.[0-9]{4,}[^ \t\r\n\]]+)"
ARXIV = r"(?i)arxiv:?[ \t\n]*([0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7}(?:v[0-9]+)?)"
YEAR = r"\b(19[5-9][0-9]|20[0-3][0-9])\b"
VENUES = (r"(?i)\b(ICML|NIPS|NeurIPS|ICLR|AAAI|IJCAI|CVPR|ICCV|ECCV)\b", r"(?i)\b(Nature|Science|Cell|PNAS)\b", r"(?i)\b(IEEE|ACM|Springer|Elsevier)\b")
REFERENCE_HEADERS = r"(?:references|bibliography|works cited|[0-9]+\.[ \t]*references)"
