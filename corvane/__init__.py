"""corvane: Spark jobs for course-assistant analytics."""
