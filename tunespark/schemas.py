"""Fields of a manifest's entries."""

REQUIRED_FIELDS = ("track_id", "title", "artist", "audio_path")
OPTIONAL_FIELDS = ("source", "license", "provider_url")
