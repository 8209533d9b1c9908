"""DataFrame operators over keyed, time-ordered bars."""
