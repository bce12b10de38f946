"""Word lists and phrases that results depend on, in their natural order."""

# Phrases that a speech model writes without anyone having said them.
BAD_PHRASES = (
    "Amara.org", "Legendas", "Obrigado", "tchau gente", "tchau tchau", "transmissão", "inscreva-se", "obrigada por assistir", "continue assistindo", "não se esqueça", "estou ouvindo", "i'm listening", "subtitles by",
    "se inscreva", "inscreva no canal", "sininho", "ative o", "ative as notificações", "deixe seu like", "deixa o like", "curta o vídeo", "curtam o vídeo", "compartilhe", "comentários", "próximo vídeo", "valeu galera",
    "até a próxima", "nos vemos", "obrigado por assistir",
)

# Whole transcriptions that are never speech.
EXACT_PHRASES = ("atenção", "música", "legenda", "legendas", "aplausos", "risos", "obrigado", "obrigada", "fim", "the end")

# First prompts of the speech model by language.
PROMPTS = {"pt": "Transcrição de conversa em português brasileiro.", "": "Transcript of a conversation."}

# Male first names.
MALE_NAMES = (
    "lucas", "mateus", "pedro", "joão", "gabriel", "rafael", "bruno", "carlos", "andré", "fernando", "ricardo", "rodrigo", "marcelo", "paulo", "thiago", "vitor", "daniel", "augusto", "leonardo", "eduardo", "henrique",
    "diego", "felipe", "guilherme", "kauan", "marcos", "jorge", "cesar", "antonio", "luis", "francisco", "manuel", "xavier", "mario", "sergio", "alberto", "manoel", "josé", "jose", "joaquim", "arthur", "miguel", "enzo",
    "bernardo", "heitor", "davi", "murilo", "caio", "christopher", "gustavo", "william", "nicolas", "victor", "ryan", "renan", "leandro", "alex", "alexandre", "anderson", "alan",
)

# Female first names.
FEMALE_NAMES = (
    "maria", "ana", "julia", "beatriz", "leticia", "amanda", "carolina", "fernanda", "mariana", "juliana", "patricia", "camila", "bruna", "aline", "bianca", "renata", "manuela", "barbara", "iris", "ines", "isis", "isadora",
    "ivana", "isabel", "joana", "josefa", "joséfina", "josiane", "jovita", "joyceana", "judite", "julieta", "jussara", "justina", "justine", "juvita", "kaila", "karina", "karla", "carla", "cassandra", "cecilia", "célia",
    "celina", "celia", "clara", "clarice", "claudia", "cleide", "cleonice", "conceição", "consuelo", "constanza", "corina", "cornelia", "coromila", "corsina", "cosma", "covadonga", "rosa", "rosana", "roselia", "vitoria",
    "vanessa", "valeria", "vanira", "veronica", "verena", "vera", "vidya", "viviana", "violeta", "vilma", "virgilia", "virginia", "antonia", "anatolia",
)

# Masculine names and the feminine ones that replace them.
FEMININE = {
    "manoel": "manuela", "manuel": "manuela", "gabriel": "gabriela", "ricardo": "ricarda", "luis": "luisa", "francisco": "francisca", "antonio": "antonia", "rio": "ria", "mario": "maria", "carlos": "carla", "paulo": "paula",
    "julio": "julia", "sergio": "serbia", "pedro": "petra",
}

# Words behind "I am" that are no names.
NOT_NAMES = (
    "lésbica", "lésbico", "gay", "trans", "travesti", "hétero", "hetero", "bissexual", "homem", "mulher", "pessoa", "alguém", "ninguém", "professor", "professora", "doutor", "doutora", "engenheiro", "engenheira", "advogado",
    "advogada", "médico", "médica", "estudante", "aluno", "aluna", "brasileiro", "brasileira", "casado", "casada", "solteiro", "solteira", "cristão", "cristã", "ateu", "ateia", "católico", "católica", "tímido", "tímida",
    "ansioso", "ansiosa", "feliz", "triste", "novo", "nova", "velho", "velha", "gordo", "gorda", "magro", "magra", "claro", "ou", "mas", "porque", "porém", "pois", "logo", "talvez", "nunca", "sempre", "ainda", "também",
    "aliás", "legal", "verdade", "exato", "beleza", "tranquilo", "show", "viado", "meu", "minha", "nosso", "nossa", "simplesmente", "maravilha", "perfeito", "exatamente", "piloto", "obrigado", "american", "british",
    "brazilian", "english", "canadian", "irish", "australian", "german", "french", "spanish", "italian", "indian", "chinese", "japanese", "scottish", "welsh", "european", "marketing", "sorry", "sure", "fine", "okay",
    "afraid", "glad", "ready", "done", "here", "good", "happy", "straight",
)

# Words that open or close a sentence and look like a name.
NOT_VOCATIVES = (
    "pessoal", "gente", "galera", "turma", "cara", "mano", "brother", "professor", "professora", "doutor", "doutora", "obrigado", "obrigada", "desculpa", "tchau", "oi", "olá", "olha", "olhe", "sim", "não", "bom", "boa",
    "tudo", "certo", "pronto", "então", "agora", "aqui", "assim", "tipo", "enfim", "viu", "sabe", "entendeu", "claro", "ou", "mas", "porque", "porém", "pois", "logo", "talvez", "nunca", "sempre", "ainda", "também", "aliás",
    "legal", "verdade", "exato", "beleza", "tranquilo", "show", "viado", "meu", "minha", "nosso", "nossa", "dele", "dela", "isso", "esse", "essa", "aquele", "aquela", "qual", "quem", "onde", "como", "quando", "quanto",
    "vamos", "bora", "hein", "né", "pô", "putz", "caramba", "caraca", "maravilha", "perfeito", "exatamente", "simplesmente", "yeah", "yep", "yes", "no", "nope", "ok", "okay", "so", "well", "right", "now", "look", "hey",
    "hi", "hello", "um", "uh", "hmm", "oh", "ah", "anyway", "alright", "actually", "basically", "like", "sure", "maybe", "please", "thanks", "thank", "sorry", "exactly", "totally", "honestly", "obviously", "listen",
    "wait", "and", "but", "or", "because", "then", "also", "just", "really", "here", "there", "this", "that", "what", "who", "when", "where", "why", "how", "which", "guys", "everyone", "folks", "man", "dude", "mean",
)

# What speakers say of themselves, by gender.
FEMALE_MARKERS = (r"\beu sou a\b", r"\bsou a\b", r"\bsou mulher", r"\bmeu nome é\s+[a-zà-ú]+a\b")
MALE_MARKERS = (r"\beu sou o\b", r"\bsou o\b", r"\bsou homem", r"\bmeu nome é\s+[a-zà-ú]+o\b")

# Patterns of introductions, vocatives, invitations and mentions; a name is one or two capitalised words.
NAME = "[A-ZÀ-Ú][a-zà-ú]+"
INTRODUCTIONS = (
    rf"(?i:meu nome é|me chamo|eu sou|sou o|sou a)\s+({NAME}(?:\s+{NAME})?)",
    rf"(?i:aqui é|aqui quem fala é)\s+(?:o|a)?\s*({NAME}(?:\s+{NAME})?)",
    rf"\b(?i:i'?m|i am|my name(?:'s| is)|this is|call me)\s+({NAME}(?:\s+{NAME})?)",
)
VOCATIVES = (rf"^({NAME}(?:\s+{NAME})?)\s*,", rf",\s*({NAME}(?:\s+{NAME})?)\s*[?.!]?\s*$")
INVITATIONS = (rf"(?:fala|vai|pode falar|sua vez|manda)\s*,?\s*({NAME})", rf"(?:obrigad[oa]|valeu)\s*,?\s*({NAME})")
MENTIONS = (rf"(?:d[oa]|com o|com a|que o|que a)\s+({NAME}(?:\s+{NAME})?)", rf"(?:parte|vez|turno|projeto|trabalho)\s+d[oa]\s+({NAME})")
