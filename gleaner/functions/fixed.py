"""Fixed values that results depend on: lists, patterns and constants of the query language."""

# Directories that a tree scan does not enter.
SKIPPED_DIRECTORIES = """
.git .svn .hg .idea .vs .vscode node_modules __pycache__ .mypy_cache .pytest_cache .ruff_cache
build dist bin obj out target venv .venv env .tox .eggs site-packages
""".split()

# Extensions that a tree scan reads.
SEARCHED_EXTENSIONS = """
.py .pyi .pyw .js .jsx .ts .tsx .mjs .cjs .c .h .cpp .hpp .cc .cxx .hxx .hh .inl .cs .java .kt .kts .scala .swift
.m .mm .go .rs .rb .php .lua .dart .ex .exs .sh .bash .zsh .ps1 .bat .cmd .sql .r .jl .hs .ml .clj .vim
.txt .md .rst .json .yaml .yml .toml .ini .cfg .conf .xml .html .css .scss .less
""".split()
MAX_FILE_BYTES = 1_000_000
MAX_LINE_CHARS = 5000

# Languages by extension; anything else has braces.
PYTHON_EXTENSIONS = ".py .pyi .pyw".split()
C_LIKE_EXTENSIONS = """
.c .h .cpp .hpp .cc .cxx .hxx .hh .cs .java .kt .scala .go .rs .swift .m .mm .inl
.js .ts .jsx .tsx .php .rb .lua .dart
""".split()

# Terms that are never rare.
COMMON_TERMS = """
the a an is are was were be been being have has had do does did will would could should may might can shall
to of in for on with at by from as into through then return void int char bool float double auto class struct
enum public private protected static virtual const inline true false null nullptr this self new delete using
namespace import export def if else for while and or not none pass try except finally with lambda yield async await
""".split()

# Words that carry no content in a question.
QUESTION_WORDS = """
the a an and or of to in for with when where how why what which does do did is are was were be been should could
would can will my our this that these those it its on at by from into over under not no if then than so
make makes made use uses using get gets sets set
""".split()

# Suffixes that the stemmer tries in this order, if four characters are left.
STEM_SUFFIXES = "ation izing ized ing ies ion ers ed es er s".split()

DEFINITION_LINE = r"^\s*(?:export\s+)?(?:pub\s+)?(?:static\s+)?(?:async\s+)?(?:def|class|fn|func|function|impl|trait|interface|struct|enum|type)\b"
SYMBOL_AFTER_KEYWORD = r"(?:class|struct|enum|def|fn|func|function|proc|method|impl|trait|interface|void|int|char|bool|auto|static|virtual|const)\s+(\w+)"
SYMBOL_CALLED = r"\b(\w+)\s*\("
PYTHON_HEADER = r"^(\s*)(?:async\s+def\s|def\s|class\s)"
DEFINING_SUBSTRINGS = "class struct def fn func function proc void int char bool auto impl trait".split()
VENDORED_SUBSTRINGS = "vendor node_modules __pycache__ .git build dist generated auto-generated .min.js .bundle".split()
COMMENT_STARTS = ("//", "/*", "*", "#", "--")

# A block opens, in C-like languages, on a line like this.
C_LIKE_OPEN = (
    r"^\s*(?:(?:static|virtual|const|inline|unsigned|signed|extern|template|public|private|protected|friend|explicit"
    r"|constexpr|noexcept|decltype|auto|void|int|char|bool|float|double|size_t|uint\w+|int\w+"
    r"|class|struct|enum|union|namespace)\s+)*"
    r"(?:class|struct|enum|union|namespace|if|else|for|while|do|switch|case|try|catch|finally|with|def|fn|func"
    r"|function|proc|method|impl|trait|interface|type|module|package)\b"
)
C_LIKE_CLOSE = r"^\s*[\}\)]"

# A quantified group whose body is quantified without bound.
NESTED_QUANTIFIER = r"\((?![?]P?[=!<])[^()]*(?:[+*]|\{\d+,\s*\}?)[^()]*\)\s*(?:[+*]|\{\d+,\s*\}?)"

# Symbols that history does not follow.
SYMBOL_STOP = """
import return yield raise assert lambda global nonlocal print super self None True False class match case while
elif else except finally
""".split()

# Words that say nothing about what a session looks for.
FOCUS_STOP = """
the and for that this with from what when where which have has was were are you your can could would should please
make just like into then than them they there here how why does did not but all any its it's use using file files
code line lines read look see run add fix check need want get let one two new now out off our own way who will also some
""".split()

# Suffixes of files whose large reads are replaced, and lines that a file map shows.
CODE_SUFFIXES = """
.py .pyi .js .jsx .ts .tsx .mjs .cjs .rs .go .java .kt .c .h .cc .cpp .hpp .cs .rb .php .swift .scala .sh .bash .lua
.pl .r .m .mm .vue .svelte .sql .zig .dart .ex .exs .hs
""".split()
MAP_LINE = (
    r"^\s*(?:@|(?:async\s+)?def\s|class\s|func\s|fn\s|function\s|(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s|"
    r"(?:public|private|protected|static|final)\s|(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\(|"
    r"(?:pub\s+)?(?:struct|enum|trait|impl|interface|type)\s)"
)

# Recall, fusion and packing.
BM25_K1, BM25_B = 1.2, 0.75
WINDOW_LINES, WINDOW_STRIDE = 60, 40
BLOCK_SPLIT_OVER, BLOCK_LINES, BLOCK_STRIDE = 90, 70, 60
RECALL_LIMIT, RERANK_HEAD = 40, 250
TEXT_WEIGHT, CHURN_WEIGHT, COCHANGE_WEIGHT = 1.0, 0.3, 0.5
DECAY_SECONDS = 90 * 86400
MIN_COMMITS = 5
SAME_FILE_PENALTY = 6
DOMINANCE, DOMINANT_SHARE, LEXICAL_SHARE, VAGUE_SHARE = 1.8, 0.55, 0.65, 0.25
ROUTER_WEIGHTS = (-2.0264, 1.4161, 0.3591, -1.2606, -1.2075, -0.0575, -0.8742)
