"""DataFrame-to-DataFrame operators over notes, rolls, tokens and events."""
