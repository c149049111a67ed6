"""Word lists and tables of the language rules.

Fixed values: results depend on each of them as it stands; every operator takes them as parameters.
"""

# Chat slang and its normal form; known misspellings.
SLANG = {
    "норм": "нормально", "нзч": "не за что", "спс": "спасибо", "пж": "пожалуйста", "плз": "пожалуйста", "пжл": "пожалуйста", "пжлст": "пожалуйста",
    "оч": "очень", "ооч": "очень", "чё": "что", "чо": "что", "шо": "что", "щас": "сейчас", "ща": "сейчас", "щя": "сейчас", "скок": "сколько",
    "скока": "сколько", "чел": "человек", "челик": "человек", "комп": "компьютер", "ноут": "ноутбук", "инфа": "информация", "универ": "университет",
    "препод": "преподаватель", "контра": "контрольная", "лаба": "лабораторная", "домашка": "домашняя работа", "тыща": "тысяча", "лан": "ладно",
    "ладн": "ладно", "канеш": "конечно", "канешн": "конечно", "конеш": "конечно", "наверн": "наверное", "наверно": "наверное", "прост": "просто",
    "проста": "просто", "ваще": "вообще", "вааще": "вообще", "вобще": "вообще", "вобщем": "в общем", "впринципе": "в принципе", "кста": "кстати",
    "кстат": "кстати", "кор": "короче", "короч": "короче", "крч": "короче", "мб": "может быть", "имхо": "по моему мнению", "имо": "по моему мнению",
    "кмк": "как мне кажется", "хз": "не знаю", "тг": "телеграм", "тгк": "телеграм канал", "ирл": "в реальной жизни", "сорян": "извини",
    "сори": "извини", "сорри": "извини", "здрасте": "здравствуйте", "здрасьте": "здравствуйте", "прив": "привет", "привки": "привет",
    "даров": "привет", "дарова": "привет", "пок": "пока", "покеда": "пока", "покедова": "пока", "досвидос": "до свидания", "тк": "так как",
    "тп": "типа", "типо": "типа", "чтоб": "чтобы", "штоб": "чтобы", "штобы": "чтобы", "што": "что", "шта": "что", "ктото": "кто-то",
    "чтото": "что-то", "гдето": "где-то", "когдато": "когда-то", "какойто": "какой-то", "какието": "какие-то", "изза": "из-за",
    "ченибудь": "что-нибудь", "когданибудь": "когда-нибудь", "ктонибудь": "кто-нибудь", "седня": "сегодня", "сёдня": "сегодня", "тож": "тоже",
    "тожа": "тоже", "чёт": "что-то", "чет": "что-то", "ниче": "ничего", "ничё": "ничего", "нич": "ничего",
}
MISSPELLINGS = {
    "вроди": "вроде", "ассицировал": "ассоциировал", "отрийание": "отрицание", "одиночесва": "одиночества", "ьейки": "тейки", "говрю": "говорю",
    "неполноценнсть": "неполноценность", "виднееются": "виднеются", "ссвязь": "связь", "какта": "как-то", "чемьо": "чем-то", "цыфры": "цифры",
    "престностью": "пресностью", "ммне": "мне",
}

# Beginnings of segments that belong to the segment before them.
SUBORDINATE_PREFIXES = (
    "что ", "чтобы ", "чтоб ", "как ", "будто ", "словно ", "который ", "которая ", "которое ", "которые ", "которого ", "которой ", "которому ",
    "которым ", "которых ",
)

# Messages without content.
TRIVIAL = (
    "привет", "прив", "здарова", "хай", "ок", "окей", "ладно", "лан", "ахах", "ахахах", "ахахахах", "хаха", "хахах", "хахаха", "лол", "кек", "ну",
    "да", "нет", "не", "а", "ага", "угу", "ну да", "ну ок", "спасибо", "спс", "пасиб", "хорош", "норм", "круто", "класс", "пока", "ночи",
    "доброе утро", "добрый день", "хм", "ммм", "жиза", "кста", "кстати", "бля", "блин", "хз", "хех", "хехе", "хехех", "эм", "ээ", "мм", "оо", "ооо",
    "аа", "ааа", "найс", "го", "давай", "ясно", "понятно", "понял", "поняла",
)

# Clause and noun-phrase classification.
ILP_ADJECTIVES = (
    "смертный", "разумный", "свободный", "живой", "сильный", "слабый", "способный", "достойный", "виновный", "ответственный", "честный", "умный",
    "глупый", "добрый", "злой", "красивый", "прекрасный", "счастливый", "несчастный", "одинокий", "важный", "нужный",
)
SLP_VERBS = (
    "прийти", "уйти", "упасть", "сказать", "увидеть", "взять", "дать", "купить", "продать", "найти", "потерять", "позвонить", "написать", "отправить",
    "получить", "начать", "закончить",
)
HABITUAL_MARKERS = (
    "обычно", "часто", "всегда", "иногда", "редко", "бывает", "случается", "порой", "нередко",
)
HABITUAL_BIGRAMS = (
    "как правило",
)
TEMPORAL_MARKERS = (
    "вчера", "сегодня", "завтра", "потом", "тогда", "сейчас", "недавно", "утром", "вечером",
)
TEMPORAL_BIGRAMS = (
    "только что",
)
GENERIC_MARKS = (
    "если", "когда", "пока", "раз", "как только",
)
DETERMINERS = (
    "этот", "тот", "один", "какой-то", "некий", "такой", "другой", "мой", "твой", "наш", "ваш", "свой", "его", "её", "их",
)
QUASI_GENERIC_NOUNS = (
    "человек", "люди", "вещь", "штука", "место", "раз", "часть", "пара", "тип", "чувак", "девушка", "парень", "мужчина", "женщина", "ребёнок", "друг",
    "знакомый",
)
ABSTRACT_NOUNS = (
    "свобода", "любовь", "ответственность", "справедливость", "истина", "правда", "ложь", "счастье", "страдание", "смысл", "жизнь", "смерть", "время",
    "пространство", "сознание", "мышление", "душа", "разум", "воля", "красота", "добро", "зло", "вера", "надежда", "мужество", "честь", "долг",
    "достоинство",
)
SELF_PRONOUNS = (
    "я", "себя",
)
INTERLOCUTORS = (
    "ты", "вы",
)

# Extraction: verb intensities, modal envelopes (type, weight, neg-raising), quantifiers, negation, pointers, adverbs.
VERB_INTENSITY = {
    "требовать": 0.9, "нуждаться": 0.8, "просить": 0.6, "включать": 0.8, "содержать": 0.8, "иметь": 0.7, "являться": 1.0, "быть": 0.7,
    "создавать": 0.9, "порождать": 0.9, "вызывать": 0.8, "давать": 0.7, "позволять": 0.7, "помогать": 0.6, "разрушать": 0.8, "мешать": 0.7,
    "отрицать": 0.8, "любить": 0.7, "ненавидеть": 0.9, "хотеть": 0.6, "думать": 0.5, "считать": 0.6, "знать": 0.8, "делать": 0.6, "использовать": 0.7,
    "строить": 0.7,
}
ENVELOPES = {
    "знать": ("FACTUAL", 1.0, False), "верить": ("EPISTEMIC", 0.5, False), "думать": ("EPISTEMIC", 0.5, True), "считать": ("EPISTEMIC", 0.6, True),
    "полагать": ("EPISTEMIC", 0.5, True), "хотеть": ("DESIDERATIVE", 0.6, False), "мечтать": ("DESIDERATIVE", 0.5, False),
    "бояться": ("EPISTEMIC", 0.4, False), "сомневаться": ("EPISTEMIC", 0.3, False), "надеяться": ("DESIDERATIVE", 0.5, False),
}
QUANTIFIERS = {
    "все": 1.3, "весь": 1.3, "каждый": 1.4, "любой": 1.2, "всегда": 1.3, "некоторый": 0.7, "какой-то": 0.6, "один": 0.5, "иногда": 0.6,
}
NEGATIVE_PARTICLES = (
    "не", "ни",
)
NEGATIVE_PRONOUNS = (
    "никто", "ничто", "никогда", "нигде", "никак", "никакой",
)
CONDITIONAL_MARKS = (
    "если", "когда", "раз",
)
DISCOURSE_POINTERS = (
    "проблема", "вопрос", "суть", "дело", "причина", "цель", "задача", "смысл", "итог", "вывод", "результат", "следствие", "условие", "основа",
    "главное", "важное", "интересное",
)
ADVERB_FACTORS = {
    "немного": 0.5, "слегка": 0.5, "чуть": 0.5, "очень": 1.3, "крайне": 1.4, "абсолютно": 1.5, "совершенно": 1.5, "весьма": 1.2, "довольно": 1.1,
}

# Thesaurus relations: verb, base intensity, negative.
CONCEPTNET_RELATIONS = {
    "IsA": ("является", 0.8, False), "PartOf": ("входит_в", 0.7, False), "HasA": ("имеет", 0.7, False), "UsedFor": ("используется_для", 0.6, False),
    "CapableOf": ("способен_на", 0.6, False), "HasProperty": ("amod", 0.6, False), "MadeOf": ("состоит_из", 0.7, False),
    "Causes": ("вызывает", 0.6, False), "CreatedBy": ("создаётся", 0.6, False), "DefinedAs": ("определяется_как", 0.8, False),
    "Synonym": ("эквивалентен", 0.9, False), "Antonym": ("противоположен", 0.8, True), "AtLocation": ("находится_в", 0.5, False),
    "RelatedTo": ("связан_с", 0.4, False), "DerivedFrom": ("образовано_от", 0.5, False), "SimilarTo": ("похож_на", 0.6, False),
    "Desires": ("желает", 0.5, False), "ReceivesAction": ("подвергается", 0.5, False), "HasSubevent": ("включает_шаг", 0.5, False),
    "HasPrerequisite": ("требует", 0.6, False), "HasFirstSubevent": ("начинается_с", 0.5, False), "HasLastSubevent": ("заканчивается", 0.5, False),
    "MotivatedByGoal": ("мотивировано", 0.5, False), "CausesDesire": ("вызывает_желание", 0.5, False),
}
RUWORDNET_RELATIONS = {
    "hypernym": ("является_видом", 0.9, False), "hyponym": ("включает_вид", 0.9, False), "part_of": ("часть", 0.7, False),
    "has_part": ("содержит_часть", 0.7, False), "antonym": ("противоположен", 0.8, True), "instance": ("экземпляр", 0.8, False),
    "cause": ("вызывает", 0.6, False), "entailment": ("влечёт", 0.6, False), "domain": ("область", 0.5, False),
}

# Words that never become concepts; verbs that tell of oneself.
PRONOUNS = (
    "я", "ты", "вы", "он", "она", "мы", "они", "оно", "это", "что", "кто", "который", "какой", "свой", "себя", "его", "её", "их", "нас", "вас", "то",
    "все", "всё", "всë", "нет", "да", "так", "тут", "там", "вот", "ничто", "нечто", "кое-что", "мм", "ну", "ага", "ладно", "окей", "целое", "весь",
    "сам", "такой", "другой", "каждый", "любой",
)
SELF_IDENTITY_VERBS = (
    "являться", "быть", "стать", "становиться", "считать", "казаться", "оказаться", "выглядеть", "представлять",
)
SELF_RELATION_VERBS = (
    "хотеть", "любить", "ненавидеть", "бояться", "уметь", "понимать", "верить", "чувствовать", "ощущать", "стремиться", "нуждаться", "ценить",
    "предпочитать", "уважать", "презирать", "искать", "ждать", "надеяться", "мечтать",
)
SELF_DEPENDENCIES = (
    "amod", "cop:это", "nmod:gen",
)

# Content that the sentence qualifier refuses: profanity, sexual content, slurs.
REFUSED = (
    r"[её]б(?:а[тлнш]|у[чтн]|[её]т|ну[тл]|ли|ло|ла|ись|[её]ш|ан|ён|[её]н)|за[её]б|про[её]б|от[её]б|вы[её]б|у[её]б|на[её]б|"
    r"об[её]б|пере[её]б|[её]бать|[её]бёт|[её]бут|[её]бись|[её]бал|[её]бло|[её]бла|пизд|хуй|хуя|хуе|хую|хуёв|бляд|блять|"
    r"сук[аи]\b|сучк|сучар|муда[кч]|пидор|пидар|пидр|сперм|оргазм|порн|минет|фелляц|куннил|анал(?:ьн)|пенис|вагин|дроч|"
    r"подроч|надроч|задроч|передроч|трахал|трахну|трахать|сосал[аи]|сосут|секс(?:ом|а|у|е|уальн)|изнасил|педофил|срать|"
    r"ссать|посра|посре|поссы|насра|обосра|засра|говн[оауе]|дерьм[оауе]|залуп|жоп[аеуыо]|чурк[аиео]|чурбан|нигер|нигг|"
    r"хач[аиео]?\b|жид[аыов]?\b|хохол|хохл|москал|кацап|узкоглаз|шлюх|шалав|проститу"
)
