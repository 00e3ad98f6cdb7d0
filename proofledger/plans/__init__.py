"""The jobs: staging, checks, profiles, questions, fingerprints, replay, verdicts."""
