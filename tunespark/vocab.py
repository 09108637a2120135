"""Fixed vocabularies, thresholds and limits."""

from __future__ import annotations

# --- fixed values: tagger classes by label, thresholds, query words, limits -------------------------------------
VOCAL_CLASSES = ("Singing", "Male singing", "Female singing", "Child singing", "Rapping", "Vocal music", "A capella", "Choir", "Humming", "Yodeling")
VOCAL_ON, VOCAL_OFF = 0.02, 0.01
GENRE_CLASSES = {
    "pop": ("Pop music",),
    "rock": ("Rock music", "Punk rock", "Grunge", "Progressive rock", "Rock and roll", "Psychedelic rock"),
    "metal": ("Heavy metal",),
    "hip hop": ("Hip hop music",),
    "r&b": ("Rhythm and blues", "Soul music", "Funk"),
    "country": ("Country", "Bluegrass"),
    "folk": ("Folk music",),
    "jazz": ("Jazz", "Swing music"),
    "blues": ("Blues",),
    "classical": ("Classical music", "Opera"),
    "electronic": ("Electronic music", "House music", "Techno", "Dubstep", "Drum and bass", "Electronica", "Electronic dance music", "Trance music", "Disco"),
    "ambient": ("Ambient music", "New-age music"),
    "reggae": ("Reggae",),
    "latin": ("Music of Latin America", "Salsa music", "Flamenco"),
}
GENRE_MIN = 0.02
MOOD_CLASSES = {"calm": "Tender music", "sad": "Sad music", "happy": "Happy music", "energetic": "Exciting music", "angry": "Angry music", "dark": "Scary music"}
MOOD_MIN, MAX_MOODS = 0.008, 3
PULSE_MIN = 0.25
ENERGY_BANDS = ("low", "medium", "high")
TEMPO_LIMITS = (30.0, 300.0)
TEMPO_CLOSE = 0.08
SYNONYMS = {
    "vocals": ("vocals", "vocal"), "singing": ("vocals", "vocal"), "singer": ("vocals", "vocal"), "sung": ("vocals", "vocal"), "rapping": ("vocals", "vocal"), "rapper": ("vocals", "vocal"),
    "rap": ("genre", "hip hop"), "hiphop": ("genre", "hip hop"), "edm": ("genre", "electronic"), "electronica": ("genre", "electronic"),
    "relaxing": ("mood", "calm"), "relaxed": ("mood", "calm"), "chill": ("mood", "calm"), "peaceful": ("mood", "calm"), "gentle": ("mood", "calm"),
    "melancholy": ("mood", "sad"), "melancholic": ("mood", "sad"), "cheerful": ("mood", "happy"), "joyful": ("mood", "happy"),
    "exciting": ("mood", "energetic"), "aggressive": ("mood", "angry"), "scary": ("mood", "dark"), "eerie": ("mood", "dark"), "spooky": ("mood", "dark"),
}
NEGATIONS, NEGATION_WINDOW = ("no", "not", "without", "non", "never"), 3
MAX_K, DEFAULT_K, MAX_QUERY_CHARS, ARTIST_CAP, MMR_LAMBDA, MMR_POOL = 50, 10, 400, 2, 0.7, 50
FEEDBACK_ACTIONS = ("SAVE", "REJECT", "OPEN", "SKIP")
NORM_MIN, UNIT_TOLERANCE = 1e-6, 1e-3
# ------------------------------------------------------------------------------------------------------------------

LABELS = {"vocals": ("vocal", "instrumental"), "genre": tuple(GENRE_CLASSES), "mood": tuple(MOOD_CLASSES)}
CLASSES = tuple(sorted({*VOCAL_CLASSES, *(c for own in GENRE_CLASSES.values() for c in own), *MOOD_CLASSES.values()}))
#: Word of a query -> (attribute, value).
QUERY_WORDS = {label.replace(" ", ""): (attribute, label) for attribute, labels in LABELS.items() for label in labels} | SYNONYMS
