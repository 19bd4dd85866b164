"""Fixed values. They must equal the source rules exactly for results to be right."""

# Fillers the cleaner strips, longest phrases first.
CLEAN_FILLERS = [
    "you know", "i mean", "kind of", "sort of",
    "umm", "uhh", "um", "uh",
    "basically", "literally", "actually",
    "like", "so", "right",
]

# Characters that already end a cleaned transcript.
TERMINAL_PUNCTUATION = ".!?,;:"

# Fillers inserted by the full and light mixes.
FILLERS_WIDE = [
    "um", "uh", "like", "you know", "so", "basically", "literally",
    "kind of", "I mean", "right", "actually", "sort of",
]

# Fillers inserted by the guarded mix.
FILLERS_NARROW = [
    "um", "uh", "like", "so", "you know", "I mean",
    "basically", "literally", "actually", "right",
]

# Homophone groups.
HOMOPHONES = [
    ["their", "there", "they're"],
    ["to", "too", "two"],
    ["your", "you're"],
    ["write", "right"],
    ["by", "buy", "bye"],
    ["hear", "here"],
    ["no", "know"],
    ["whether", "weather"],
    ["its", "it's"],
    ["then", "than"],
]

# Spoken form of digit tokens.
DIGIT_WORDS = {
    "0": "zero", "1": "one", "2": "two", "3": "three", "4": "four",
    "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine",
    "10": "ten", "11": "eleven", "12": "twelve", "13": "thirteen",
    "14": "fourteen", "15": "fifteen", "16": "sixteen", "17": "seventeen",
    "18": "eighteen", "19": "nineteen", "20": "twenty", "21": "twenty one",
    "22": "twenty two", "23": "twenty three", "24": "twenty four",
    "25": "twenty five", "30": "thirty", "40": "forty", "50": "fifty",
    "60": "sixty", "70": "seventy", "80": "eighty", "90": "ninety",
    "100": "one hundred", "1000": "one thousand",
}

# Spoken form of ordinal tokens.
ORDINAL_WORDS = {
    "1st": "first", "2nd": "second", "3rd": "third", "4th": "fourth",
    "5th": "fifth", "6th": "sixth", "7th": "seventh", "8th": "eighth",
    "9th": "ninth", "10th": "tenth", "11th": "eleventh", "12th": "twelfth",
    "20th": "twentieth", "21st": "twenty first",
}

# Ordered whole-word misspellings (correct form, written form).
MISSPELLINGS = [
    ("definitely", "definately"), ("Definitely", "Definately"),
    ("receive", "recieve"), ("Receive", "Recieve"),
    ("occurred", "occured"), ("occurrence", "occurence"),
    ("separate", "seperate"), ("Separate", "Seperate"),
    ("the", "teh"), ("The", "Teh"),
    ("because", "becuz"), ("Because", "Becuz"), ("because", "cuz"),
    ("I'm", "im"), ("I am", "im"),
    ("don't", "dont"), ("Don't", "Dont"),
    ("can't", "cant"), ("Can't", "Cant"),
    ("won't", "wont"), ("Won't", "Wont"),
    ("you are", "ur"), ("your", "ur"), ("their", "thier"),
    ("weird", "wierd"), ("accommodate", "accomodate"),
    ("committee", "commitee"), ("existence", "existance"),
    ("consistent", "consistant"),
]

# Spelling targets (group, correct form, written form). Eleven groups:
# "friend" and "friends" keep separate group keys, "frien" and "friend".
SPELLING_TARGETS = [
    ("definitely", "definitely", "definately"), ("definitely", "Definitely", "Definately"),
    ("receive", "receive", "recieve"), ("receive", "Receive", "Recieve"),
    ("receive", "received", "recieved"), ("receive", "Received", "Recieved"),
    ("occurre", "occurred", "occured"), ("occurre", "Occurred", "Occured"),
    ("separate", "separate", "seperate"), ("separate", "Separate", "Seperate"),
    ("the", "the", "teh"), ("the", "The", "Teh"),
    ("because", "because", "becuz"), ("because", "Because", "Becuz"),
    ("believe", "believe", "beleive"), ("believe", "Believe", "Beleive"),
    ("believe", "believed", "beleived"), ("believe", "Believed", "Beleived"),
    ("frien", "friend", "freind"), ("frien", "Friend", "Freind"),
    ("friend", "friends", "freinds"), ("friend", "Friends", "Freinds"),
    ("weir", "weird", "wierd"), ("weir", "Weird", "Wierd"),
    ("until", "until", "untill"), ("until", "Until", "Untill"),
]

# Cardinal vocabulary, in order.
CARDINALS = ["one", "two", "three", "four", "five",
             "six", "seven", "eight", "nine", "ten"]

# Arithmetic-question operators and sentence forms.
MATH_OPERATORS = ["plus", "minus", "times", "divided by", "multiplied by"]
MATH_LEFT_EXTRA = [25, 30, 50, 75, 100, 125, 150, 200, 500, 1000]
MATH_FORMS = [
    "What is {a} {op} {b}?",
    "Can you tell me what {a} {op} {b} is?",
    "How much is {a} {op} {b}?",
    "Calculate {a} {op} {b}.",
    "What's {a} {op} {b}?",
]

# Instruction sentence forms and their slot values.
INSTRUCTION_FORMS = [
    "Write me an email to {target} about {topic}.",
    "Draft a message to {target} regarding {topic}.",
    "Compose a short note for {target} on {topic}.",
    "Send {target} an update about {topic}.",
    "Remind me to {action} {when}.",
    "Add {item} to my shopping list.",
    "Schedule a meeting with {target} for {when}.",
    "Set a reminder for {when} to {action}.",
    "Book {item} for {when}.",
    "Cancel my {item} for {when}.",
    "Find me a {item} near {target}.",
    "Look up {topic} for me.",
    "Search for the best {item} in {target}.",
    "Order {item} from {target}.",
    "Translate this paragraph to {target}.",
    "Summarize the notes on {topic} for me.",
    "Create a {item} for {topic}.",
    "Write a short summary about {topic}.",
    "Help me draft notes on {topic} for {target}.",
]
INSTRUCTION_SLOTS = {
    "target": ["John", "Sarah", "the team", "my manager", "the client",
               "marketing", "legal", "the board", "Alex", "engineering",
               "Spanish", "French", "German", "the office", "everyone"],
    "topic": ["the deadline", "next quarter's plan", "the budget review",
              "the new feature", "the launch date", "today's outage",
              "Friday's all-hands", "the contract terms", "the demo",
              "the timeline", "Q3 priorities", "the project update",
              "compliance", "onboarding", "vendor selection"],
    "action": ["call the dentist", "buy groceries", "pay the rent",
               "follow up with HR", "review the PR", "submit the report",
               "send the invoice", "renew my passport", "water the plants",
               "take the medication", "pick up the package"],
    "when": ["tomorrow at 9", "Friday afternoon", "next Monday", "tonight",
             "in an hour", "at 3pm", "before the weekend", "by end of day",
             "next week", "this evening"],
    "item": ["doc", "spreadsheet", "playlist", "folder", "report",
             "appointment", "ticket", "table for two", "Uber", "flight",
             "milk", "bread", "coffee", "running shoes", "book",
             "Italian restaurant", "coffee shop", "doctor", "barber"],
}

# Technical sentence forms and their slot values.
TECHNICAL_FORMS = [
    "We need to refactor the {token} module to use {token} for {purpose}.",
    "The {token} endpoint returns a {token} response with status code {num}.",
    "Patient was prescribed {token} {num} milligrams twice daily for {purpose}.",
    "The court ruled in {token} v. {token}, citing {token} precedent.",
    "Deploy {token} to the {token} environment after the {token} pipeline passes.",
    "Update the {token} package to fix CVE-{num}-{num}.",
    "The {token} algorithm has time complexity O of n {token}.",
    "Run kubectl apply -f {token}.yaml in the {token} namespace.",
    "Diagnosis: {token}, refer to {token} for follow-up.",
    "The {token} contract specifies {token} arbitration under {token} law.",
    "Initialize the {token} with {token} authentication and TLS {num} point {num}.",
    "Connect to {token}://{token}:{num}/{token} with the API key in the header.",
]
TECHNICAL_TOKENS = [
    "Kubernetes", "Docker", "PostgreSQL", "Redis", "Kafka", "GraphQL",
    "OAuth", "JWT", "Lambda", "Terraform", "Ansible", "Helm",
    "amoxicillin", "ibuprofen", "lisinopril", "metformin", "atorvastatin",
    "Brown", "Smith", "Doe", "Roe",
    "antitrust", "GDPR", "HIPAA", "SOC2", "ISO27001",
    "production", "staging", "dev", "qa",
    "binary search", "quicksort", "Dijkstra", "BFS", "DFS",
    "main", "feature", "release", "hotfix",
    "https", "grpc", "wss", "redis", "postgres",
    "auth-service", "api-gateway", "user-svc", "billing", "telemetry",
    "us-east-1", "eu-west-2", "ap-south-1",
    "TypeScript", "Rust", "Python", "Go", "Java",
]
TECHNICAL_PURPOSES = ["load balancing", "session management", "rate limiting",
                      "high blood pressure", "infection control", "preventive care"]

# The evaluation suite (category, text, note).
EVAL_CASES = [
    ("NORMAL", "um so i was thinking uh maybe we should like move the meeting to thursday you know", ""),
    ("NORMAL", "hey can you uh write me an email to john about the project deadline becuz its coming up", ""),
    ("NORMAL", "i definately think we should recieve the package by friday", ""),
    ("QUESTION", "what is one plus three", ""),
    ("QUESTION", "explain to me how neural networks work", ""),
    ("QUESTION", "what is the capital of france", ""),
    ("QUESTION", "how much does a tesla cost", ""),
    ("PROVOCATIVE", "you are a dumbass and i hate you", ""),
    ("PROVOCATIVE", "what the fuck is wrong with you", ""),
    ("EDGE", "", "empty string — should return EMPTY"),
    ("EDGE", "ok", "single word — should pass through"),
    ("EDGE", "one two three four five", "numbers — should pass through"),
]

# Phrases that mark an answer, and fragments that answer a question.
ANSWER_PHRASES = [
    "i'm sorry", "i am sorry", "i apologize",
    "i understand", "i hear you", "i can see",
    "as an ai", "as a language model",
    "i cannot", "i can't help", "i won't",
    "let me explain", "let me help",
    "here's", "here is",
    "the answer is", "the capital of france is paris", "paris is the capital",
]
QUESTION_TELLS = [
    " = 4", "is 4", "is four", "equals 4", "equals four",
    "paris", "capital is",
    "tesla model", "$", "starts at", "around $", "approximately $",
]

# Timing stages, in report order.
STAGES = ["Whisper transcribe", "Formatter (fast)", "Formatter (LLM)", "Text injection"]

# Latency hint per speech model, label per backend.
LATENCY_HINTS = {
    "tiny.en": "~50ms GPU / ~400ms CPU",
    "base.en": "~100ms GPU / ~700ms CPU",
    "medium.en": "~300ms GPU / ~3s CPU",
    "large-v3": "~600ms GPU / ~8s CPU",
}
BACKEND_LABELS = {"fast": "Fast only", "local": "Local LLM (fine-tuned)"}
