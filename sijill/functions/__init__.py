"""Part of sijill; see the README for what lives here."""
