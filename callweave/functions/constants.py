"""Names, codes and word lists that results must share."""

#: The five classes, in the order of their ids.
CLASSES = ("anger", "frustration", "sadness", "neutral", "satisfaction")
ANGER, FRUSTRATION, SADNESS, NEUTRAL, SATISFACTION = range(5)

#: Source emotions of dialogue corpora; None drops the row.
EMOTIONS = {
    "anger": "anger",
    "disgust": "anger",
    "fear": "frustration",
    "joy": "satisfaction",
    "neutral": "neutral",
    "sadness": "sadness",
    "surprise": None,
}

#: Emotion codes, intensities and sentences of acted clips.
ACTED_EMOTIONS = {"ANG": "anger", "DIS": "anger", "FEA": None, "HAP": "satisfaction", "NEU": "neutral", "SAD": "sadness"}
INTENSITIES = {"LO": "low", "MD": "medium", "HI": "high", "XX": "unspecified"}
SENTENCES = {
    "IEO": "It's eleven o'clock.",
    "TIE": "That is exactly what happened.",
    "IOM": "I'm on my way to the meeting.",
    "IWW": "I wonder what this is about.",
    "TAI": "The airplane is almost full.",
    "MTI": "Maybe tomorrow it will be cold.",
    "IWL": "I would like a new alarm clock.",
    "ITH": "I think I have a doctor's appointment.",
    "DFA": "Don't forget a jacket.",
    "ITS": "I think I've seen this before.",
    "TSI": "The surface is slick.",
    "WSI": "We'll stop in a couple of minutes.",
}

#: Groups of the default group-disjoint split.
VAL_ACTORS = ("1051", "1052", "1053", "1054", "1055")
TEST_ACTORS = ("1085", "1086", "1087", "1088", "1089", "1090", "1091")

#: Typographic characters and their plain forms; zero-width characters go.
PLAIN = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'",
    "\u201c": '"', "\u201d": '"', "\u201e": '"',
    "\u2013": "-", "\u2014": "-", "\u2015": "-",
    "\u2026": "...",
    "\u00a0": " ", "\u2009": " ",
    "\u200b": "", "\u200c": "", "\u200d": "", "\ufeff": "",
}

#: Phrases that give generated text away, in the order in which they are reported.
BANNED_PHRASES = (
    "as an ai", "as a language model", "i cannot", "i'm sorry, but",
    "openai", "i was generated", "[insert", "<insert",
    "the customer", "the speaker", "the persona",
    " sounds frustrated", " is frustrated about", " is angry about",
    "the user is", "the customer is",
)
MIN_WORDS, MAX_WORDS, MIN_SCORE, MAX_INTENSITY_GAP = 4, 60, 3, 2

#: Columns of the four models, in the order of the feature row.
TEXT_COLUMNS = ("prob_anger", "prob_frust", "prob_sadne", "prob_neutr", "prob_satis")
GOEMO_COLUMNS = ("goemo_anger", "goemo_disgust", "goemo_fear", "goemo_joy", "goemo_neutral", "goemo_sadness")
LEXICON_COLUMNS = ("vader_pos", "vader_neg", "vader_neu", "vader_compound")
AUDIO_COLUMNS = ("sb_ang", "sb_hap", "sb_sad", "sb_neu")
FEATURES = TEXT_COLUMNS + GOEMO_COLUMNS + LEXICON_COLUMNS + AUDIO_COLUMNS
COMPONENTS = {"text": TEXT_COLUMNS, "goemo": GOEMO_COLUMNS, "lexicon": LEXICON_COLUMNS, "audio": AUDIO_COLUMNS}
#: Models in the order of ties.
MODELS = ("text", "goemo", "lexicon", "audio")

#: Soft class probabilities of a compound score: up to a bound, with the bound or not.
LEXICON_BUCKETS = (
    (-0.3, False, (0.5, 0.3, 0.15, 0.05, 0.0)),
    (-0.05, False, (0.15, 0.25, 0.4, 0.2, 0.0)),
    (0.1, True, (0.0, 0.1, 0.15, 0.6, 0.15)),
    (0.3, True, (0.1, 0.0, 0.1, 0.35, 0.45)),
    (None, True, (0.05, 0.0, 0.1, 0.25, 0.6)),
)
#: Emotions that each class adds up.
GOEMO_OF_CLASS = {"anger": ("anger",), "frustration": ("disgust", "fear"), "sadness": ("sadness",), "neutral": ("neutral", "surprise"), "satisfaction": ("joy",)}
#: Audio emotions in the order of the model, and their classes.
AUDIO_OF_CLASS = {"neu": "neutral", "hap": "satisfaction", "ang": "anger", "sad": "sadness"}

#: Grids of the two weight searches.
TEXT_ALPHAS, TEXT_BETAS = (0.3, 0.4, 0.5, 0.6), (0.2, 0.3, 0.4)
FUSION_LEVELS = (0.1, 0.3, 0.5, 0.7)

#: Axes of generated texts.
_NEGATIVE = ("wait_time", "technical_issue", "billing_error", "product_defect", "policy_dispute", "rude_agent", "broken_promise", "third_call")
CLASS_RULES = {
    "anger": ((3, 4, 5), _NEGATIVE, ("explicit_anger", "sarcastic", "exasperated", "passive_aggressive", "polite_but_firm")),
    "frustration": ((2, 3, 4, 5), _NEGATIVE, ("explicit_anger", "passive_aggressive", "sarcastic", "exasperated", "polite_but_firm", "rambling")),
    "sadness": ((2, 3, 4), _NEGATIVE, ("tearful", "exasperated", "rambling", "polite_but_firm")),
    "neutral": ((1, 2), ("info_request", "verification", "small_talk", "wait_time", "self_correction"), ("matter_of_fact", "polite_formal", "casual")),
    "satisfaction": ((3, 4, 5), ("issue_resolved", "good_service", "compliment", "gratitude"), ("grateful", "warm", "casual", "polite_formal")),
}
PERSONAS = ("young_informal", "elderly_formal", "business_user", "technically_savvy", "first_time_caller", "regular_complainant")
TURNS = ("opening", "mid_call", "escalation", "closing")
SHORT_NAMES = {"anger": "anger", "frustration": "frust", "sadness": "sad", "neutral": "neut", "satisfaction": "satis"}
INTENSITY_WORDS = {1: "very mild", 2: "mild", 3: "moderate", 4: "strong", 5: "extreme"}
VOICES = ("alloy", "ash", "ballad", "coral", "echo", "fable", "onyx", "nova", "sage", "shimmer", "verse")

#: Parts of a speech instruction.
TONES = {
    1: "calm and even",
    2: "slightly elevated",
    3: "noticeably tense",
    4: "agitated and forceful",
    5: "very intense, on the edge of losing composure",
}
SPEECH_OF_CLASS = {
    "anger": "Speak as an angry customer on a phone call to support. The voice should sound assertive, confrontational, and clearly upset.",
    "frustration": "Speak as a frustrated customer who has been struggling with the same issue. The voice should convey weariness, repeated effort wasted, and growing impatience.",
    "sadness": "Speak as a customer who feels disappointed and let down. The voice should sound subdued, slightly hollow, with a touch of resignation.",
    "neutral": "Speak as a customer making a routine, non-emotional remark. The voice should be matter-of-fact, neither warm nor cold.",
    "satisfaction": "Speak as a satisfied customer whose issue has been handled well. The voice should sound warm, relieved, and grateful.",
}
STYLE_HINTS = {
    "explicit_anger": "raise volume on emphatic words, tight clipped pacing",
    "passive_aggressive": "even surface tone with sarcastic emphasis on key words",
    "sarcastic": "drawn-out sarcastic intonation, eye-rolling implied",
    "exasperated": "audible sigh-like quality, tired delivery",
    "tearful": "voice on the edge of tears, slightly wavering",
    "polite_but_firm": "controlled and measured, but with steel underneath",
    "rambling": "slightly disorganised, occasional self-correction",
    "matter_of_fact": "neutral pacing, factual",
    "polite_formal": "courteous register, careful articulation",
    "casual": "informal and relaxed",
    "grateful": "warm, slightly relieved",
    "warm": "friendly and open",
}
PERSONA_HINTS = {
    "young_informal": "younger speaker, contemporary informal English",
    "elderly_formal": "older speaker, slightly slower pace, formal phrasing",
    "business_user": "professional register, time-conscious",
    "technically_savvy": "comfortable with technical terms",
    "first_time_caller": "uncertain, maybe a bit nervous",
    "regular_complainant": "knows the routine, less patient with formalities",
}
TURN_HINTS = {
    "opening": "the call has just started",
    "mid_call": "the call is in progress",
    "escalation": "this turn is a clear escalation point",
    "closing": "this is near the end of the call",
}
SPEECH_END = "Add small naturalistic disfluencies (a brief breath, an occasional micro-pause). Do NOT shout to the point of distortion. Single take, no music or sound effects."
